"""Validation splits of an exact size, drawn by hash rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import hash_order


def validation_size(total: int, ratio: float, max_rows: int | None = None) -> int:
    """min(int(total * ratio), max_rows) with a ratio of one half at most."""
    if not 0 <= ratio <= 0.5:
        raise ValueError("ratio must be between 0 and 0.5")
    n = int(total * ratio)
    return n if max_rows is None else min(n, max_rows)


def split_validation(df: DataFrame, keys: Sequence[str], n_validation: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): validation has exactly n rows, the smallest by hash of seed and keys, which must identify a row.

    Only the hash rank's border is found by a top-n of keys; both sides are then plain filters of one scan.
    """
    if n_validation <= 0:
        return df, df.limit(0)
    order = hash_order(seed, *[F.col(k) for k in keys])
    rank = F.struct(order[0].alias("h"), *[F.col(k) for k in keys])
    border = df.select(rank.alias("r")).orderBy("r").limit(n_validation).agg(F.max("r").alias("r")).first().r
    if border is None:
        return df, df
    edge = F.struct(*[F.lit(v).alias(n) for n, v in border.asDict().items()])
    return df.where(rank > edge), df.where(rank <= edge)


def split_tail(df: DataFrame, keys: Sequence[str], n_rows: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rest, validation) with the last n rows of the shuffled order as validation."""
    total = df.count()
    head, tail = split_validation(df, keys, max(0, total - n_rows), seed)
    return tail, head
