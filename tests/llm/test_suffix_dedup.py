import hashlib
from collections import Counter

from lodestream.llm import suffix_dedup


def brute(rows, depth=200):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - depth + 1):
            count[b[s : s + depth]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if count[b[s : s + depth]] > 1:
                gone[s : s + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffix_dedup.apply(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r)) == brute(rows, options.get("depth", 200))


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_equals_brute_force(spark, corpus_rows):
    check(spark, corpus_rows)


def test_many_small_blocks(spark, corpus_rows, monkeypatch):
    from lodestream.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "BUCKET_ENTRIES", 700)
    monkeypatch.setattr(suffix_dedup, "PIECE", 997)
    check(spark, corpus_rows, depth=150)


def test_empty(spark):
    assert suffix_dedup.apply(spark.createDataFrame([], "doc_id long, text string")).collect() == []
