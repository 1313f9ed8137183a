"""The tree against a plain recursive one, and the law of near equal bytes."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestream.llm import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DIMS = ("source", "lang", "n_chars", "doc_id")


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def brute(rows, shards):
    copies, nodes = Counter(), []
    for i, text, lang, source, n in rows:
        size, crc = len((text or "").encode()) + 1, zlib.crc32((text or "").encode())
        place = [-1.0 if x is None else float(number(x)) for x in (source, lang)] + [-1.0 if n is None else math.log2(1 + n) if n >= 0 else float(n), -1.0 if i is None else float(i)]
        parts = [i, size, crc, source, lang, n, i]
        tie = number("|".join(str(x) for x in [*parts, copies[tuple(parts)]] if x is not None))
        copies[tuple(parts)] += 1
        nodes.append((place, tie, i, size, crc))
    extent = lambda some, d: max(x[0][d] for x in some) - min(x[0][d] for x in some)
    widths = [extent(nodes, d) for d in range(4)] if nodes else []
    out = []

    def cut(some, first, k):
        if not some:
            return
        if k == 1:
            some = sorted(some, key=lambda x: (x[1], x[2] is not None, x[2], x[4], x[3]))
            out.extend((i, size, crc, first, slot) for slot, (_, _, i, size, crc) in enumerate(some))
            return
        d = max(range(4), key=lambda d: (extent(some, d) / widths[d] if widths[d] else 0.0, -d))
        goal, before, left, right = sum(x[3] for x in some) * (k // 2) // k, 0, [], []
        for x in sorted(some, key=lambda x: (x[0][d], x[1])):
            (left if 2 * (goal - before) >= x[3] else right).append(x)
            before += x[3]
        cut(left, first, k // 2)
        cut(right, first + k // 2, k - k // 2)

    cut(nodes, 0, shards)
    return sorted(out, key=str)


def found(spark, rows, shards):
    df = kd_shards.assign(spark.createDataFrame(rows, SCHEMA), shards, DIMS, logarithmic=("n_chars",))
    return sorted([tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()], key=str)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_edges(spark, corpus_rows, shards):
    """Nulls in every column, empty and long texts, copies, repeated rows and a source of a third of the rows."""
    rows = [(i, t, ("en", "de", None)[k % 3], f"s{k % 7}" if k % 3 else "hot", None if k % 11 == 0 else len(t or "")) for k, (i, t) in enumerate(corpus_rows)]
    rows += [(None, None, None, None, None)] * 40 + [(3, "same", "en", "hot", 4)] * 60 + [(5, "", "", "", -3)]
    got = found(spark, rows, shards)
    assert got == brute(rows, shards)
    for shard in {r[3] for r in got}:
        slots = sorted(r[4] for r in got if r[3] == shard)
        assert slots == list(range(len(slots)))


def test_near_equal(spark, sf_dir):
    sizes = kd_shards.apply(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("largest")).collect()
    mean = sum(r.n for r in sizes) / 16
    assert len(sizes) == 16 and all(abs(r.n - mean) <= max(x.largest for x in sizes) for r in sizes)


def test_small_tables(spark):
    assert found(spark, [], 16) == []
    assert found(spark, [(1, None, None, None, None)], 16) == brute([(1, None, None, None, None)], 16)
    with pytest.raises(ValueError):
        found(spark, [], 0)


def test_clashing_columns_and_blocks(spark, monkeypatch):
    """More copies than a block are numbered in blocks."""
    monkeypatch.setattr(kd_shards, "BLOCK", 7)
    rows = [(1, "x", "en", "s", 1)] * 50 + [(2, "y", "en", "s", 1)] * 7
    assert found(spark, rows, 3) == brute(rows, 3)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, size int, c int, tie int")
    assert kd_shards.apply(df).count() == 57


def test_native(spark, sf_dir):
    plan = kd_shards.apply(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
