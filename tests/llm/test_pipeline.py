import random

import corpus_pipeline
from lodestream.llm import components, quality_model, queries

D = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.keep(stage(spark, docs, D), name)
        assert out.columns == columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and len(ids) <= before
        docs, before = out, len(ids)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert tokens.count() == before
    assert docs.where("length(text) != n_chars").count() == 0


def test_first_stage_drops_what_the_classifier_rejects(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    bad = {r.doc_id for r in quality_model.apply(docs, labels).where("predicted = 0").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, D).collect()}
    assert bad and kept == {r.doc_id for r in docs.collect()} - bad


def test_near_duplicates_keep_one_of_each_group(spark):
    base = [f"word{i}" for i in range(100)]
    near = base[:50] + ["changed"] + base[51:]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (4, "something else entirely"), (4, "something else entirely"), (5, ""), (6, None), (None, "x y z")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, df, D)
    assert sorted([r.doc_id for r in out.collect()], key=str) == [1, 4, 5, 6, None]
    assert out.columns == df.columns
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), D).collect() == []


def test_passages_go_and_emptied_documents_with_them(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start {passage} end"), (2, f"other {passage} tail"), (3, passage), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, D).collect()}
    assert out == {1: rows[0][1], 2: "other tail", 4: ""}


def test_run_and_registry(spark):
    out = queries.QUERIES["pipeline"](spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert out.count() > 50
    assert sorted(k for k in queries.QUERIES if k.startswith("op")) == sorted(f"op{n}_{x}" for n, x in enumerate(["substring_dedup", "suffix_dedup", "jaccard_join", "html_text", "quality_model", "bpe", "quality_rules", "language", "decontaminate", "url_filter", "kd_shards", "prefix_trie", "filter_audit"], 1))
