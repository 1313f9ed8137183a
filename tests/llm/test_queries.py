"""The registered queries over whole tables, against brute force."""

import hashlib
import re

import public_tokenizers
import test_decontaminate
import test_jaccard_join
import test_quality_rules
import test_substring_dedup
import test_suffix_dedup
import test_url_filter
from tokenizers import Tokenizer

from lodestream.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name, *columns):
    return sorted([tuple(r) for r in QUERIES[name](spark, D).select(*columns).collect()], key=str)


def test_op1(spark):
    got = result(spark, "op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(test_substring_dedup.brute(documents(spark)), key=str)
    assert sum(r[2] for r in got) > 0


def test_op2(spark):
    got = result(spark, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(test_suffix_dedup.brute(documents(spark)), key=str)
    assert sum(r[2] for r in got) > 0


def test_op3(spark):
    assert result(spark, "op3_jaccard_join", "doc_id", "n_shingles", "component_id") == test_jaccard_join.brute(documents(spark), 3, 90)


def test_op4(spark):
    """The generator's pages hold their article's title and the paragraphs."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    rows = QUERIES["op4_html_text"](spark, D).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        assert len(r.text) == r.n_chars > 0
        assert re.sub(r"[^a-z]", "", r.text.lower().replace("&", "amp")) == re.sub(r"[^a-z]", "", re.sub(r"<[^>]*>", "", article).lower().replace("&quot;", ""))


def test_op5(spark):
    rows = QUERIES["op5_quality_model"](spark, D).collect()
    assert len(rows) == len(documents(spark)) and all(r.predicted == (r.score >= 0.3) for r in rows)


def test_op6(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in documents(spark):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert result(spark, "op6_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op7(spark):
    got = result(spark, "op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted([(i, *test_quality_rules.brute(t)) for i, t in documents(spark)], key=str)


def test_op8(spark):
    rows = QUERIES["op8_language"](spark, D).collect()
    assert len(rows) == len(documents(spark)) and sum(r.lang == r.declared for r in rows) / len(rows) > 0.98
    pages = QUERIES["language_of_pages"](spark, D).collect()
    assert len(pages) == 50 and sum(r.lang == r.declared for r in pages) / 50 > 0.95


def test_op9(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert set(result(spark, "op9_decontaminate", "doc_id", "item_id")) == test_decontaminate.brute(documents(spark), items)


def test_op10(spark):
    for r in QUERIES["op10_url_filter"](spark, D).join(spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url"), "page_id").collect():
        host, path = test_url_filter.parse(r.url)
        rule, verdict = test_url_filter.ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
