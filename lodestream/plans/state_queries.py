"""Queries of streams with state, each against a sequential version in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.rowgroups import LazyIndex
from ..streaming import chunks, state
from .lazy_queries import _chunks_sql
from .queries import SEED, fresh, query, read

_ARRIVALS = "SELECT l_suppkey AS consumer, l_partkey AS part, l_orderkey * 10 + l_linenumber AS place, CAST(l_quantity AS BIGINT) AS size FROM lineitem"
_LIMIT = 400
_GONE = f"len([i for i in range(len(q)) if coalesce(list_sum([x.size for x in q[i + 1:]]), 0) > {_LIMIT}])"


@query(f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY place, part) AS i FROM ({_ARRIVALS})),
run AS (SELECT consumer, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS part, false AS admitted, CAST([] AS STRUCT(part BIGINT, size BIGINT)[]) AS held, CAST([] AS BIGINT[]) AS gone FROM (SELECT DISTINCT consumer FROM a)
UNION ALL SELECT consumer, i, place, part, admitted, q[{_GONE} + 1:], [x.part for x in q[1:{_GONE}]]
FROM (SELECT a.consumer, a.i, a.place, a.part, NOT list_contains([x.part for x in run.held], a.part) AS admitted,
  CASE WHEN list_contains([x.part for x in run.held], a.part) THEN run.held ELSE list_append(run.held, {{'part': a.part, 'size': a.size}}) END AS q FROM run JOIN a ON a.consumer = run.consumer AND a.i = run.i + 1))
SELECT consumer, part, place, CASE WHEN admitted THEN 'admit' ELSE 'skip' END AS event FROM run WHERE i > 0
UNION ALL SELECT consumer, unnest(gone), place, 'evict' FROM run""")
def resident_dedup_stream(spark, d):
    """Suppliers' lines as samples of consumers, keyed by part, over three micro-batches: a part is skipped while its cache holds it and admitted again once evicted."""
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("consumer"), F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_quantity").cast("long").alias("size"))
    base = fresh(spark, "resident")
    borders = lines.select(F.percentile_approx("place", [0.3, 0.7]).alias("p")).first().p
    for lo, hi in zip([None, *borders], [*borders, None], strict=True):  # each part is what has arrived since the last run
        part = lines if lo is None else lines.where(F.col("place") >= lo)
        (part if hi is None else part.where(F.col("place") < hi)).write.mode("append").parquet(f"{base}/in")
        with state.rocksdb(spark):
            made = state.resident_stream(state.read_stream(spark, f"{base}/in", lines.schema), "consumer", "part", "place", "size", _LIMIT)
            state.run_available(made, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{base}/out")


_EPOCH = lambda e: f"SELECT CAST({e} AS BIGINT) AS epoch, tag, o_orderkey, tag // (3 * size) AS batch FROM (WITH {_chunks_sql('orders', 350, 1, 2, e)} SELECT y.*, size FROM y, m)"


#: Streams that share the micro-batches of an epoch; each costs the driver about 80 MB for Python.
_LANES = 4
#: A micro-batch's own folder is written again as a whole if it fails, so its file needs no second move and no mark.
_SMALL = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


@query(f"{_EPOCH(0)} UNION ALL {_EPOCH(1)}")
def chunk_stream_epochs(spark, d):
    """Two epochs of a consumer's chunks, at most three a micro-batch, in lanes that are each stopped after the first batch and restarted from their checkpoint."""
    base, lazy = fresh(spark, "chunks"), LazyIndex.of(read(spark, d, "orders"))

    def start(lane: int, available: bool):
        at = f"{base}/checkpoint/{lane}"
        rows = chunks.chunk_stream(spark, lazy, 350, 1, 2, SEED, epochs=2, per_trigger=3, checkpoint=at, columns=["o_orderkey"], lane=lane, lanes=_LANES)
        written = rows.select(F.col("_epoch").alias("epoch"), F.col("_tag").alias("tag"), "o_orderkey")
        save = lambda df, i: df.write.mode("overwrite").options(**_SMALL).parquet(f"{base}/out/lane={lane}/no={i}")
        writer = written.writeStream.foreachBatch(save).option("checkpointLocation", at)
        return (writer.trigger(availableNow=True) if available else writer).start()

    def run(available: bool) -> None:
        streams = []
        try:
            with chunks.plain_checkpoints(spark):
                for lane in range(_LANES):
                    streams.append(start(lane, available))
            for stream in streams:
                stream.awaitTermination() if available else stream.processAllAvailable()
        finally:
            for stream in streams:
                stream.stop()

    run(True)  # what may be admitted at the start: one batch
    run(False)
    done = spark.read.schema("epoch long, tag long, o_orderkey long, lane int, no long").parquet(f"{base}/out")
    ends = done.groupBy("epoch", "lane").agg(F.min("no").alias("first"), (F.max("no") - F.min("no") + 1).alias("n"))
    before = Window.partitionBy("epoch").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = ends.select("epoch", "lane", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))  # a row per lane and epoch
    return done.join(F.broadcast(lanes), ["epoch", "lane"]).select("epoch", "tag", "o_orderkey", (F.col("no") + F.col("shift")).cast("long").alias("batch"))
