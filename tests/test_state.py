"""Bounded caches: eviction by merged ranges, keys that are admitted again, chunks under back-pressure."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import cache
from lodestream.streaming import state


def evicted(sizes, limit):
    """Arrivals in order: at which arrival each sample leaves."""
    out, held, usage = [None] * len(sizes), [], 0
    for n, size in enumerate(sizes):
        held.append(n)
        usage += size
        while held and usage > limit:
            old = held.pop(0)
            usage -= sizes[old]
            out[old] = n
    return out


@pytest.mark.parametrize("limit", [0, 1, 37, 5_000, 10**9])
def test_eviction_at_any_limit(spark, limit):
    """One consumer with a huge sample among thousands of tiny and empty ones, one with equal sizes, one with a single sample."""
    r = random.Random(limit)
    sizes = {"a": [r.choice([0, 1, 1, 2]) for _ in range(900)] + [4_000] + [r.choice([0, 1]) for _ in range(600)], "b": [10] * 300, "c": [7]}
    rows = [(g, i, n) for g, s in sizes.items() for i, n in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, place long, size long")
    got = {(r.g, r.place): r.evicted_at for r in cache.eviction(df, "place", "size", limit, ["g"], chunk=100).collect()}
    assert got == {(g, i): at for g, s in sizes.items() for i, at in enumerate(evicted(s, limit))}
    whole = {r.place: r.evicted_at for r in cache.eviction(df.where("g = 'a'").drop("g"), "place", "size", limit, chunk=100).collect()}
    assert whole == dict(enumerate(evicted(sizes["a"], limit)))


@pytest.mark.parametrize("limit", [1, 1_000, 10**8])
def test_no_range_grows_with_the_limit(spark, limit):
    rows = spark.range(4000).select(F.col("id").alias("place"), F.when(F.col("id") == 2000, 10**7).otherwise(F.col("id") % 3).alias("size"))
    sums = cache.prefix_sums(rows.withColumn("_chunk", F.floor(F.col("place") / 100)), "_chunk", "place", "size", [], "usage")
    counts = [r["count"] for r in cache._axis(sums, [], "place", "size", limit, 40).groupBy("_range").count().collect()]
    assert sum(counts) == 8000 and max(counts) <= 3 * 200


def resident(rows, limit):
    """Sequential: skip what is held, admit the rest, evict the oldest."""
    held, out = {}, []
    for g, k, o, n in sorted(rows, key=lambda r: (r[0], r[2])):
        mine = held.setdefault(g, {})
        if k in mine:
            out.append((g, k, o, state.SKIP))
            continue
        mine[k] = n
        out.append((g, k, o, state.ADMIT))
        while mine and sum(mine.values()) > limit:
            old = next(iter(mine))
            del mine[old]
            out.append((g, old, o, state.EVICT))
    return sorted(out)


def test_dedup_while_resident(spark, tmp_path):
    """Over several micro-batches and a restart; samples of no bytes and samples larger than the cache."""
    r = random.Random(5)
    rows = [(f"g{r.randrange(3)}", f"k{r.randrange(25)}", o, r.choice([0, 1, 5, 9, 200])) for o in range(900)]
    kind = "g string, k string, o long, n long"
    found = []
    with state.rocksdb(spark):
        for part in range(3):
            spark.createDataFrame(rows[part * 300 : part * 300 + 150], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            spark.createDataFrame(rows[part * 300 + 150 : part * 300 + 300], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = state.read_stream(spark, str(tmp_path / "in"), kind, max_files=1)
            state.run_available(state.resident_stream(source, "g", "k", "o", "n", 40), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = resident(rows, 40)
    assert found == want
    again = [x for x in want if x[3] == state.ADMIT]
    assert len(again) > len({x[:2] for x in again})  # keys that came back
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_queue_of_several_blocks(spark, tmp_path, monkeypatch):
    """Blocks that stay, are filled up, shortened, used up and come back empty; state is called per block, not per row."""
    monkeypatch.setattr(state, "BLOCK", 4)
    r = random.Random(6)
    kind, rows = "g long, k long, o long, n long", []
    with state.rocksdb(spark):
        for part in range(5):
            new = [(r.randrange(2), r.randrange(60), part * 100 + o, 50 if part == 3 and o > 90 else r.choice([0, 1, 2])) for o in range(100)]
            rows += new
            spark.createDataFrame(new, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            made = state.resident_stream(state.read_stream(spark, str(tmp_path / "in"), kind), "g", "k", "o", "n", 25)
            state.run_available(made, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = sorted(resident(rows, 25))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_chunks_are_admitted_few_at_a_time(spark, tmp_path):
    """No batch holds more than its chunks; a stream that is stopped amid an epoch goes on from its checkpoint; order and places are the dataset's."""
    from lodestream.plans.index import StreamingSource
    from lodestream.sources.rowgroups import LazyIndex
    from lodestream.streaming.chunks import chunk_stream

    spark.range(0, 1000, 1, 3).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "t"))
    lazy = LazyIndex.of(spark.read.parquet(str(tmp_path / "t")))
    batches = {}

    def run(available, **more):
        rows = chunk_stream(spark, lazy, 60, 1, 3, seed=8, epoch=2, per_trigger=2, checkpoint=str(tmp_path / "c"), **more)
        writer = rows.writeStream.foreachBatch(lambda df, i: batches.__setitem__(i, [tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c"))
        stream = (writer.trigger(availableNow=True) if available else writer).start()
        stream.awaitTermination() if available else stream.processAllAvailable()
        stream.stop()

    run(True)
    assert len(batches) == 1 and len(batches[0]) == 2 * 55
    run(False)
    assert len(batches) == 3 and all(len(b) <= 2 * 55 for b in batches.values())
    source = StreamingSource(spark, str(tmp_path / "t" / "*.parquet"), "TEXT", key="id", shuffle_seed=8, lazy=True, chunk_size=60)
    want = [(r.lo, r.tag) for r in source.chunks(1, 3, 2).orderBy("tag").collect()]
    rows = [r for i in sorted(batches) for r in batches[i]]
    assert sorted({(min(p for _, p, t, _ in rows if t == tag), tag) for _, _, tag, _ in rows}, key=lambda x: x[1]) == want
    assert len(rows) == len({r[1] for r in rows}) == 330 and {r[3] for r in rows} == {2}
    assert [t // 110 for t in sorted({r[2] for r in rows})] == [0, 0, 1, 1, 2, 2]


def test_chunk_order_is_made_once_an_epoch(monkeypatch):
    """Not for every micro-batch, which made planning quadratic in the chunks."""
    from pyspark.sql import types as T

    from lodestream.streaming import chunks

    made, plain = [], chunks.chunk_order
    monkeypatch.setattr(chunks, "chunk_order", lambda *a: made.append(a) or plain(*a))
    told = {"groups": "", "start": "0", "size": "10", "pieces": "30", "rank": "0", "epochs": "2", "per_trigger": "3", "seed": "7", "epoch": "0", "chunk": "0"}
    reader, at, seen = chunks.ChunkReader(T.StructType(), told), {"epoch": 0, "chunk": 0}, []
    while (end := reader.latestOffset()) != at:
        seen += [(c.epoch, c.lo // 10) for c in reader.partitions(at, end)]
        at = end
    assert seen == [(e, i) for e in range(2) for i in plain(30, 7, e, 0)] and len(made) == 2


@pytest.mark.parametrize("pieces, lanes, first, per_task", [(30, 4, 0, 1), (31, 4, 17, 2), (2, 5, 1, 3), (0, 2, 0, 1), (7, 1, 3, 9)])
def test_lanes_share_the_micro_batches_of_an_epoch(pieces, lanes, first, per_task):
    """Together they hand out what one stream does: the same batches of at most three chunks, none twice, in two epochs; also from amid an epoch, and with lanes that have nothing to do."""
    from pyspark.sql import types as T

    from lodestream.streaming import chunks

    def batches(lane, lanes):
        told = {"groups": "", "start": "0", "size": "10", "pieces": pieces, "rank": "0", "epochs": "2", "per_trigger": "3", "seed": "7", "epoch": "4", "chunk": first // 3 * 3, "per_task": per_task, "lane": lane, "lanes": lanes}
        reader, found = chunks.ChunkReader(T.StructType(), {k: str(v) for k, v in told.items()}), []
        at = reader.initialOffset()
        while (end := reader.latestOffset()) != at:
            tasks = reader.partitions(at, end)
            assert all(len(t.parts) <= per_task for t in tasks)
            found.append([(c.epoch, c.tag, c.lo, c.hi) for t in tasks for c in t.parts])
            at = end
        return found

    whole = batches(0, 1)
    assert sorted(b for lane in range(lanes) for b in batches(lane, lanes)) == sorted(whole)
    assert all(len(b) <= 3 and len({c[0] for c in b}) == 1 for b in whole) and sum(map(len, whole)) == max(0, 2 * pieces - first // 3 * 3)
    if pieces == 30:
        assert [len(batches(lane, lanes)) for lane in range(lanes)] == [4, 6, 4, 6]


def test_lanes_go_on_from_their_checkpoints(spark, tmp_path):
    """Two streams at once, stopped after a batch each: chosen columns, small chunks in one task, every chunk of both epochs once."""
    from lodestream.sources.rowgroups import LazyIndex
    from lodestream.streaming import chunks

    spark.range(0, 1000, 1, 3).selectExpr("id", "id * 2 AS twice").write.parquet(str(tmp_path / "t"))
    lazy, found, setting = LazyIndex.of(spark.read.parquet(str(tmp_path / "t"))), {}, "spark.sql.streaming.checkpointFileManagerClass"

    def start(lane, available):
        rows = chunks.chunk_stream(spark, lazy, 60, 1, 3, seed=8, epochs=2, per_trigger=2, checkpoint=str(tmp_path / f"c{lane}"), columns=["twice"], lane=lane, lanes=2)
        assert rows.columns == ["twice", "_pos", "_tag", "_epoch"]
        save = lambda df, i: found.__setitem__((lane, i), (df.rdd.getNumPartitions(), [tuple(r) for r in df.collect()]))
        writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / f"c{lane}"))
        return (writer.trigger(availableNow=True) if available else writer).start()

    before = spark.conf.get(setting, None)
    for available in (True, False):
        with chunks.plain_checkpoints(spark):
            streams = [start(lane, available) for lane in range(2)]
        for s in streams:
            s.awaitTermination() if available else s.processAllAvailable()
            s.stop()
        assert spark.conf.get(setting, None) == before
        assert not available or sorted(found) == [(0, 0), (1, 0)]
    assert sorted(found) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert all(tasks == 1 and len(rows) == 110 for tasks, rows in found.values())
    rows = [r for _, rows in found.values() for r in rows]
    assert sorted((r[3], r[1]) for r in rows) == [(e, p) for e in range(2) for p in range(333, 663)] and all(r[0] == 2 * r[1] for r in rows)
    assert [sorted({r[2] // 110 for r in found[k][1]}) for k in sorted(found)] == [[0], [0], [1], [2], [1], [2]]
