import hashlib
import re

from lodestream.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    docs = {}
    for i, t in rows:
        docs[(-1 if i is None else i), t] = WORD.findall(t or "")
    seen, out = {}, {}
    for key in sorted(docs, key=lambda k: (k[0], k[1] or "")):
        for s in range(len(docs[key]) - window + 1):
            seen.setdefault(tuple(docs[key][s : s + window]), (key, s))
    for key, words in docs.items():
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] != (key, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[key[0]] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [(i, *out[-1 if i is None else i]) for i, _ in rows]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0]))


def test_equals_brute_force(spark, corpus_rows):
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substring_dedup.apply(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert order(got) == order(brute(corpus_rows))


def test_many_small_blocks(spark, corpus_rows, monkeypatch):
    from lodestream.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "BUCKET_ENTRIES", 500)
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string").withColumnRenamed("text", "body")
    df = df.selectExpr("doc_id", "body", "'x' as key", "1 as block", "'y' as first")
    got = [tuple(r) for r in substring_dedup.apply(df, text_col="body").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert order(got) == order(brute(corpus_rows))


def test_text_and_empty(spark, corpus_rows):
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string")
    for r in substring_dedup.apply(df, with_text=True).collect():
        if r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.apply(df.limit(0)).collect() == []
