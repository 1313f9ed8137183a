"""Reproducible orders: by hash of seed and key, by affine permutation, by epoch and consumer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import coprime, mixed_seed, offset


def hash_order(seed: int, *keys: Column) -> list[Column]:
    """Sort keys of a seeded shuffle: an md5 of seed and keys, then the keys."""
    text = F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return [F.md5(text.cast("binary")), *keys]


def shuffled(df: DataFrame, seed: int | None, *keys: str) -> DataFrame:
    """Sorted in seeded order; None leaves the order alone. Spark sorts by range in parallel."""
    return df if seed is None else df.orderBy(*hash_order(seed, *[F.col(k) for k in keys]))


def first_rows(df: DataFrame, n: int, seed: int | None, *keys: str) -> DataFrame:
    """The first n rows in seeded or key order: a top-n per task and a merge, no full sort."""
    order = [F.col(k) for k in keys]
    return df.orderBy(*(order if seed is None else hash_order(seed, *order))).limit(n)


def affine(position: Column, n: int, seed: int) -> Column:
    """Where a position goes under (a * i + b) mod n: a bijection computed row by row."""
    if n * n >= 1 << 63:
        raise ValueError("n is too large for 64-bit products")
    return (position * coprime(seed, n) + offset(seed, n)) % n


def affine_split(n: int, splits: int, split: int) -> tuple[int, int]:
    """The range of positions in a split; the last takes the rest."""
    each = n // splits
    return split * each, n if split == splits - 1 else (split + 1) * each


def inverse_affine(target: Column, n: int, seed: int) -> Column:
    a, b = coprime(seed, n), offset(seed, n)
    return (target - b + n) % n * (pow(a, -1, n) if n > 1 else 0) % n


def epoch_order(df: DataFrame, seed: int | None, epoch: int, rank: int, position: str, column: str = "place", chunk: int = 1 << 20) -> DataFrame:
    """Adds each row's place in a consumer's order of an epoch. Without a seed it is the position.

    Places are counted in two levels, so no window spans all rows: rows are dealt to ranges of the
    hash, counted per range, and numbered inside their range.
    """
    if seed is None:
        return df.withColumn(column, F.col(position))
    digest = F.md5(F.concat_ws("-", F.lit(str(mixed_seed(seed, epoch, rank))), F.col(position).cast("string")).cast("binary"))
    total = df.count()
    digits = max(0, math.ceil(math.log(max(1, total / chunk), 16)))
    keyed = df.withColumn("_h", digest).withColumn("_range", F.substring("_h", 1, digits) if digits else F.lit(""))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy("_h", position)
    placed = keyed.join(before.select("_range", "_before"), "_range")
    return placed.withColumn(column, F.row_number().over(inside) - 1 + F.col("_before")).drop("_h", "_range", "_before")


def coprime_ok(a: int, n: int) -> bool:
    return math.gcd(a, n) == 1
