"""Writing indexes: Parquet with a stored position, CSV, chunks with a validation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import hash_order
from ..operators.splits import split_validation, validation_size


def save_index(df: DataFrame, path: str, mode: str = "overwrite", position: str | None = None, row_group_bytes: int = 8 << 20, stringify: bool = False) -> DataFrame:
    """Parquet. With a position, rows are range-partitioned and sorted by it, so that a later slice skips files and row groups by their statistics."""
    if stringify:
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType | T.CharType | T.VarcharType) else F.col(f"`{f.name}`") for f in df.schema])
    if position:
        df = df.repartitionByRange(position).sortWithinPartitions(position)
    df.write.mode(mode).option("parquet.block.size", row_group_bytes).option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """CSV with a header; one file only where asked for, since it takes one task."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", "true").csv(path)


def save_with_validation(df: DataFrame, path: str, keys: Sequence[str], ratio: float, max_rows: int | None = None, seed: int = 42, recompute: bool = True, row_group_bytes: int = 8 << 20) -> tuple[int, int]:
    """Writes <path> and <path>-val; returns their row counts. Without `recompute`, existing output is left alone."""
    total = df.count()
    n = validation_size(total, ratio, max_rows)
    train, validation = split_validation(df, keys, n, seed)
    mode = "overwrite" if recompute else "ignore"
    train.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)
    validation.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(f"{path}-val")
    return total - n, n


def save_shuffled(df: DataFrame, path: str, keys: Sequence[str], seed: int) -> None:
    df.orderBy(*hash_order(seed, *[F.col(k) for k in keys])).write.mode("overwrite").parquet(path)
