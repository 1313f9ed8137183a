"""Deduplication by key, fetch plans, byte accounting and first-in first-out eviction."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values
from ..sources.files import open_stream
from ..sources.shared import materialize


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in a total order. As a minimum per key it is pre-aggregated in each task, so a hot key costs one row per task."""
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_row")).select(*keys, "_row.*")


def repeat_rows(df: DataFrame, times: int, key: str) -> DataFrame:
    """Every row `times` times; the key of copy i gets the suffix _i."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn(key, F.concat_ws("_", F.col(key).cast("string"), "_copy")).drop("_copy")


def fetch_plan(df: DataFrame, key: str, columns: Sequence[str], dst: str, name: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per file to fetch: key, field, url, destination and whether it exists already (path, size > 0)."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("url"), paths.cache_path(dst, name, F.col(key), c, F.col(f"`{c}`")).alias("destination")) for c in columns])
    plan = df.select(F.col(key).alias("key"), F.explode(cells).alias("c")).select("key", "c.*").where("url is not null and url != ''")
    if existing is None:
        return plan.withColumn("skip", F.lit(False))
    have = existing.where("size > 0").select(F.col("path").alias("destination"), F.lit(True).alias("_have"), F.col("size"))
    return plan.join(have, "destination", "left").withColumn("skip", F.coalesce("_have", F.lit(False))).drop("_have")


def byte_totals(plan: DataFrame, size: str) -> DataFrame:
    """(key, total, downloaded): all bytes of a sample and those that were not there."""
    return plan.groupBy("key").agg(F.sum(size).cast("long").alias("total"), F.sum(F.when(~F.col("skip"), F.col(size)).otherwise(0)).cast("long").alias("downloaded"))


def copy_file(url: str, destination: str, retries: int = 3) -> int:
    """Copies a file of any scheme that `sources.files` opens to a path, through a temporary name, so that a reader never sees half of it; returns its size."""
    for attempt in range(retries + 1):
        part = f"{destination}.{uuid.uuid4().hex}.part"
        try:
            os.makedirs(os.path.dirname(destination), exist_ok=True)
            with open_stream(url) as source, open(part, "wb") as copy:
                shutil.copyfileobj(source, copy, 1 << 20)
            os.replace(part, destination)
            return os.path.getsize(destination)
        except OSError:
            if os.path.exists(part):
                os.remove(part)
            if attempt == retries:
                raise
    raise AssertionError


def fetch(plan: DataFrame, retries: int = 3, on_error: str = "fail") -> DataFrame:
    """Runs a plan: adds ok, error and bytes. on_error: "fail", "skip" (drop the sample) or "quarantine" (keep the row with its error)."""
    if on_error not in ("fail", "skip", "quarantine"):
        raise ValueError(f"unknown on_error {on_error!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    out.append((True, None, os.path.getsize(row.destination) if row.skip else copy_file(row.url, row.destination, retries)))
                except OSError as e:
                    if on_error == "fail":
                        raise
                    out.append((False, str(e), 0))
            yield batch.assign(ok=[o[0] for o in out], error=[o[1] for o in out], bytes=[o[2] for o in out])

    fields = ", ".join(f"`{n}` {t}" for n, t in plan.dtypes)
    done = plan.mapInPandas(run, f"{fields}, ok boolean, error string, bytes long")
    if on_error != "skip":
        return done
    bad = done.where("not ok").select("key").distinct()
    return done.join(bad, "key", "left_anti")


def eviction(df: DataFrame, order: str, size: str, limit: int | None, group: Sequence[str] = (), chunk: int = 100_000) -> DataFrame:
    """Adds `usage` (total up to this sample), `evicted_at` (the sample whose arrival evicts this one, or null) and `resident` (still kept at the end).

    After each arrival the oldest samples leave until the total is at most the limit, so sample j
    leaves at the first n with C(n) - C(j - 1) > limit, for prefix sums C. C is summed in two
    levels, per chunk of the order and then over chunks. Arrivals (at C) and departures (at the C
    that they wait for) are merged on one axis, dealt by range to tasks of about 2 * chunk rows
    whatever the limit and the sizes, and each departure takes the next arrival: inside its range,
    or else the first arrival of a later range, the state that is carried over the borders, of one
    row per range. None is no limit.
    """
    keys = list(group)
    sums = prefix_sums(df.withColumn("_chunk", F.floor(F.col(order) / chunk)), "_chunk", order, size, keys, "usage").drop("_chunk")
    kind = df.schema[order].dataType
    if limit is None:
        return sums.withColumn("evicted_at", F.lit(None).cast(kind)).withColumn("resident", F.lit(True))
    sums = materialize(sums, "usage")
    axis = _axis(sums, keys, order, size, limit, max(1, -(-sums.count() // chunk)))
    inside = Window.partitionBy(*keys, "_range").orderBy("at", "kind", "id").rowsBetween(1, Window.unboundedFollowing)
    here = axis.withColumn("_hit", F.first(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(inside)).where("kind = 1")
    borders = axis.groupBy(*keys, "_range").agg(F.min_by(F.when(F.col("kind") == 0, F.col("id")), F.when(F.col("kind") == 0, F.struct("at", "id"))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    borders = borders.select(*keys, "_range", F.first("_first", ignorenulls=True).over(later).alias("_next"))
    found = here.join(borders, [*keys, "_range"]).select(*keys, F.col("id").alias(order), F.coalesce("_hit", "_next").alias("evicted_at"))
    return sums.join(found, [*keys, order]).withColumn("resident", F.col("evicted_at").isNull())


def _axis(sums: DataFrame, keys: Sequence[str], order: str, size: str, limit: int, ranges: int) -> DataFrame:
    """Arrivals (kind 0) and departures (kind 1) in ranges of about equal numbers. A departure needs the first arrival with usage > (usage before it) + limit."""
    arrive = sums.select(*keys, F.col("usage").alias("at"), F.lit(0).alias("kind"), F.col(order).alias("id"))
    leave = sums.select(*keys, (F.col("usage") - F.col(size) + limit).alias("at"), F.lit(1).alias("kind"), F.col(order).alias("id"))
    dealt = arrive.unionByName(leave).repartitionByRange(ranges, *keys, "at", "kind", "id")
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "axis")  # written, so that a range stays what it is


def prefix_sums(df: DataFrame, chunk: str, order: str, size: str, group: Sequence[str] = (), output: str = "total") -> DataFrame:
    """Inclusive prefix sums in an order whose chunks are consecutive ranges: per chunk, then over the chunks' sums."""
    keys = list(group)
    sums = df.groupBy(*keys, chunk).agg(F.sum(size).alias("_s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, [*keys, chunk]).withColumn(output, F.sum(size).over(inside) + F.col("_before")).drop("_before")


def distinct_by_seed(df: DataFrame, seed: str, order: Sequence[str]) -> DataFrame:
    """One row per seed, the first in order, sorted by seed."""
    return keep_first(df, [seed], order).orderBy(seed)


def drop_nan_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.exists(F.col(column), lambda x: F.isnan(x)))


def real_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(~values.is_dummy(df, c))
    return df
