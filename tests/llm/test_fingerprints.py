"""Regular strings on which fingerprints with an algebraic structure collide, and groups of blocks settled in two rounds."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import test_jaccard_join
import test_quality_rules
import test_substring_dedup
import test_suffix_dedup

from lodestream.llm import blocks, jaccard_join, quality_rules, substring_dedup, suffix_dedup
from lodestream.llm.stats import same_strings
from lodestream.llm.textblock import pieces, strings, windows


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_words_differ():
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    _, _, data, off = next(pieces(pa.array([x, y])))
    h = strings(data, off[:-1], off[1:])
    assert h[0] != h[1]
    w = np.frombuffer(x.encode() + y.encode(), np.uint8).astype(np.uint64)
    assert windows(w[:1024], 1024)[0] != windows(w[1024:], 1024)[0]


def test_thue_morse_texts(spark):
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    words = lambda t: " ".join(t)
    rows = [(1, f"{x}\n{y}"), (2, words(x)), (3, words(y)), (4, f"{x} and {y} " * 3), (5, x[:100]), (6, y[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:7] for r in quality_rules.apply(df).collect())
    assert got == sorted((i, *test_quality_rules.brute(t)) for i, t in rows)
    got = [tuple(r) for r in substring_dedup.apply(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert test_substring_dedup.order(got) == test_substring_dedup.order(test_substring_dedup.brute(rows))
    assert sorted([tuple(r) for r in jaccard_join.apply(df).collect()]) == sorted(test_jaccard_join.brute(rows, 3, 90))
    test_suffix_dedup.check(spark, rows)


def test_strings_of_all_lengths():
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 3, 70, 200]))) for _ in range(400)]
    _, _, data, off = next(pieces(pa.array(texts)))
    h = strings(data, off[:-1], off[1:])
    by = {}
    for t, v in zip(texts, h.tolist(), strict=True):
        assert by.setdefault(t, v) == v
    assert len(set(by.values())) == len(by)
    some = np.flatnonzero(off[1:] > off[:-1])[::3]
    assert strings(data, off[:-1][some], off[1:][some]).tolist() == h[some].tolist()


def test_same_strings():
    data = np.frombuffer(b"abcabdab", np.uint8)
    a, b = np.array([0, 0, 0, 3]), np.array([3, 2, 2, 3])
    c, d = np.array([3, 3, 6, 6]), np.array([6, 5, 8, 8])
    assert same_strings(data, a, b, c, d).tolist() == [False, True, True, False]


@pytest.mark.parametrize("members", [1, 3])
def test_buckets_settled_in_two_rounds(spark, corpus_rows, monkeypatch, members):
    from lodestream.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(blocks, "BUCKET_ENTRIES", 3000)
    monkeypatch.setattr(blocks, "MEMBERS", members)
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.apply(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert test_substring_dedup.order(got) == test_substring_dedup.order(test_substring_dedup.brute(corpus_rows))
    test_suffix_dedup.check(spark, corpus_rows)


def test_only_the_automata_remove(spark, corpus_rows, monkeypatch):
    """Without the passages that the automata are compiled from, every text stays whole."""
    monkeypatch.setattr(substring_dedup, "fetched", lambda blocks, wants, cut, label: blocks.limit(0).selectExpr("block", "cast(null as array<struct<here:bigint,source:bigint,place:bigint,n:bigint,left:bigint,text:binary>>) as passages"))
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string").dropDuplicates(["text"])
    assert {r.n_removed for r in substring_dedup.apply(df).collect()} == {0}


def test_repeated_and_copied_rows_of_cleaned_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a {passage}", "x"), (1, f"a {passage}", "x"), (2, f"b {passage}", "y"), (3, f"a {passage}", "z"), (4, "short text", "u"), (5, "short text", "v"), (6, None, "n"), (7, "", "e"), (None, passage, "w"), (1, "other text", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnRenamed("key", "kept_text")
    got = sorted([tuple(r) for r in substring_dedup.cleaned(df).collect()], key=str)
    assert got == sorted([(None, passage, "w"), (1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (4, "short text", "u"), (5, "short text", "v"), (6, None, "n"), (7, "", "e"), (1, "other text", "o")], key=str)


@pytest.mark.parametrize("n_buckets", [3_000, 117_000, 1_200_000])
def test_rows_stay_full_at_any_number_of_buckets(n_buckets):
    """Both levels of an exchange: at least 100 entries a row and less than a second for a million of them, nothing lost."""
    r = np.random.default_rng(1)

    def timed(buckets, values):
        sender, began, rows = blocks.Sender(buckets, blocks.ENTRY), time.process_time(), []
        for part in np.array_split(values, 12):
            rows += list(sender.add(part, block=np.zeros(len(part)), place=np.arange(len(part)), check=np.zeros(len(part))))
        rows += [sender.flush()] if sender.held else []
        took = time.process_time() - began
        assert len(values) / sum(b.num_rows for b in rows) >= 100 and took < len(values) / 1e6
        return rows

    first = blocks.coarse(n_buckets)
    values = r.integers(0, 1 << 64, 3 << 20, dtype=np.uint64)
    rows = timed(first, values)
    assert sum(len(blocks.unpack(x.as_py())) for b in rows for x in b.column("fps")) == len(values)
    if first < n_buckets:  # one range of buckets, gathered from many tasks
        width = (1 << 64) // first
        timed(n_buckets, r.integers(7 * width, 8 * width, 3 << 20, dtype=np.uint64))


def test_two_levels_find_the_same(spark, corpus_rows, monkeypatch):
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string")
    told = lambda: [sorted((tuple(r) for r in op(df).collect()), key=str) for op in (substring_dedup.apply, suffix_dedup.apply, jaccard_join.apply)]
    one = told()
    monkeypatch.setattr(blocks, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(blocks, "ROW_ENTRIES", blocks.FLUSH // 3)
    assert blocks.coarse(40) == 3 and told() == one
