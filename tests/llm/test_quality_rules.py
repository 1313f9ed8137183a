import re
from collections import Counter

from lodestream.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    n = len(words)
    base = n < 10 or 100 * sum(again) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(again), base


def test_counts(spark, corpus_rows):
    rows = corpus_rows + [(900, "a\nb\na\n\n a\na"), (901, "é# ü* $%&|<> x\x0by\x0cz\u00a0w\u2003v"), (902, "x" * 3_000_000 + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumnRenamed("doc_id", "id")
    got = sorted([tuple(r)[:7] for r in quality_rules.apply(df, "id").collect()], key=str)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=str)


def test_verdicts(spark):
    good = "The quick brown fox jumps over the lazy dog. It was a sunny day, and nobody minded.\nAnother line follows with more words in it.\n"
    rows = [
        (1, good),
        (2, "Home | News | Sport | Weather | Shop | About | Contact | Help | Login | More"),
        (3, "THIS!! IS!! ALL!! SHOUTING!! AND!! NOTHING!! ELSE!! AT!! ALL!! HERE!!"),
        (4, "a### b*** c%%% d&&& e### f*** g%%% h&&& i### j*** k###"),
        (5, good + "Home | News | Sport | Weather | Shop"),
        (6, ""),
        (7, None),
        (8, good + "All rights reserved by nobody in particular"),
    ]
    out = {r.doc_id: r for r in quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert {i for i, r in out.items() if r.kept} == {1, 5, 8}
    assert out[5].cleaned == good.strip() and out[5].n_lines_removed == 1
    assert out[8].cleaned == good.strip()


def test_keeps_labelled_quality(spark):
    d = "/root/testdata/sf0.01"
    out = quality_rules.apply(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    rows = out.select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / max(1, len(bad)) < 0.1


def test_empty(spark):
    assert quality_rules.apply(spark.createDataFrame([], "doc_id long, text string")).collect() == []
