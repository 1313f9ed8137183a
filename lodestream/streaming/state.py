"""Structured Streaming: index rows as a stream, deduplication, bounded caches and event windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder; `max_files` per trigger bounds how far reading runs ahead."""
    reader = spark.readStream.schema(schema if schema is not None else spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def dedup_stream(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row per key while the watermark keeps it. Times without a zone are taken as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def event_windows(df: DataFrame, time: str, delay: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` per event-time window and key, with late rows up to the delay."""
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")


def sessions(df: DataFrame, time: str, delay: str, gap: str, keys: list[str]) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return df.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n")).select("session.start", "session.end", *keys, "n")


def cache_stream(df: DataFrame, group: str, key: str, order: str, size: str, limit: int) -> DataFrame:
    """A first-in first-out cache per group: emits (group, key, order, evicted key and at which arrival). State is what the cache holds, so it is bounded by the limit."""
    kind, order_kind = dict(df.dtypes)[key], dict(df.dtypes)[order]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        usage, held = state.get if state.exists else (0, [])
        held, out = [tuple(h) for h in held], []
        rows = pd.concat(list(batches)).sort_values(order)
        for k, o, n in zip(rows[key], rows[order], rows[size], strict=True):
            held.append((k, int(n)))
            usage += int(n)
            while held and usage > limit:
                old, bytes_ = held.pop(0)
                usage -= bytes_
                out.append((name[0], old, o))
        state.update((usage, held))
        yield pd.DataFrame(out, columns=[group, "evicted", "evicted_at"])

    group_kind = dict(df.dtypes)[group]
    return df.groupBy(group).applyInPandasWithState(step, f"{group} {group_kind}, evicted {kind}, evicted_at {order_kind}", f"usage long, held array<struct<key:{kind},size:long>>", "append", GroupStateTimeout.NoTimeout)


#: Events of `resident_stream`.
ADMIT, SKIP, EVICT = "admit", "skip", "evict"
#: Entries of a queue that are read and written together.
BLOCK = 1024


def resident_stream(df: DataFrame, group: str, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Samples admitted to a first-in first-out cache per group, each key once while it is held: (group, key, order, event).

    A key that the cache holds is skipped; a key that was evicted is admitted again. After an
    admission the oldest leave until the sizes sum to at most the limit, a sample larger than that
    at once; `order` of an eviction is the arrival that causes it. Rows of a micro-batch are taken in
    order. State is what is held, a queue in blocks of `BLOCK` entries: a micro-batch reads a group's
    blocks once, writes those that it changed and removes those that are used up, so no row costs a
    call to the state store. It needs Spark's RocksDB state store, see `rocksdb`.
    """
    kinds = dict(df.dtypes)

    class Resident(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ends = handle.getValueState("ends", "head long, tail long, usage long")
            self.queue = handle.getMapState("queue", "block long", f"first long, keys array<{kinds[key]}>, sizes array<long>")

        def handleInputRows(self, name: tuple, frames: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(frames)).sort_values([order, key], kind="stable")
            head, tail, usage = (int(x) for x in self.ends.get()) if self.ends.exists() else (0, 0, 0)
            old, before = set(range(head // BLOCK, -(-tail // BLOCK))) if head < tail else set(), tail
            queue: deque[tuple[Any, int]] = deque()
            for b in sorted(old):
                first, names, sizes = self.queue.getValue((b,))
                queue.extend(list(zip(names, sizes, strict=True))[max(0, head - first) :])
            held, out = {k for k, _ in queue}, []
            for k, o, n in zip(rows[key].tolist(), rows[order].tolist(), rows[size].tolist(), strict=True):
                if k in held:
                    out.append((k, o, SKIP))
                    continue
                queue.append((k, int(n)))
                held.add(k)
                tail, usage = tail + 1, usage + int(n)
                out.append((k, o, ADMIT))
                while queue and usage > limit:
                    gone, freed = queue.popleft()
                    held.discard(gone)
                    head, usage = head + 1, usage - int(freed)
                    out.append((gone, o, EVICT))
            kept = set(range(head // BLOCK, -(-tail // BLOCK))) if head < tail else set()
            for b in old - kept:
                self.queue.removeKey((b,))
            for b in kept:
                if (b + 1) * BLOCK > before:  # holds new entries
                    first = max(head, b * BLOCK)
                    part = list(islice(queue, first - head, min(tail, (b + 1) * BLOCK) - head))
                    self.queue.updateValue((b,), (first, [k for k, _ in part], [n for _, n in part]))
            self.ends.update((head, tail, usage))
            yield pd.DataFrame({group: [name[0]] * len(out), key: [x[0] for x in out], order: [x[1] for x in out], "event": [x[2] for x in out]})

        def close(self) -> None:
            pass

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, {order} {kinds[order]}, event string"
    return df.groupBy(group).transformWithStateInPandas(Resident(), schema, "append", "none")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, as `resident_stream` needs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(setting) if old is None else spark.conf.set(setting, old)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet; run again, it goes on where it stopped."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(df: DataFrame, consumer: str, place: str = "place") -> DataFrame:
    """(consumer, sample_in_epoch): where each consumer goes on, from what it has delivered."""
    return df.groupBy(consumer).agg((F.max(place) + 1).alias("sample_in_epoch"))


def merge_progress(old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """The later of two states."""
    return max(old, new, key=lambda s: (s["epoch"], s["sample_in_epoch"]))
