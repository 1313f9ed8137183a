"""The queries of this subpackage, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, html_text, jaccard_join, kd_shards, language, prefix_trie, quality_model, quality_rules, substring_dedup, suffix_dedup, url_filter
from .oracle import ORACLE as ORACLE
from .tables import keep, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.apply(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.apply(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.apply(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.apply(table(spark, sf_dir, "pages"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_bpe() -> str:
    """The public word-level vocabulary's file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.apply(table(spark, sf_dir, "documents"), word_bpe())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their lang column is the declared language and their source the host; they have no address suffix."""
    return language.apply(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source").withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the markup's lang attribute, the address suffix and the host; the text is the extracted main text. Pages are extracted once and kept, their other evidence beside their id, so that no row is joined by it."""
    pages = table(spark, sf_dir, "pages")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", 1).alias("declared")
    host = url_filter.parts(F.col("url"))[0].alias("host")
    told = pages.select(F.struct(F.col("page_id").alias("id"), host, declared).alias("page"), "url", "html")
    texts = html_text.apply(told, "page").select("page_id.id", "page_id.host", "page_id.declared", "text")
    texts = keep(texts.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)), "page_texts")
    return language.apply(texts, "id", "text", "declared", "host", "suffix").withColumnRenamed("id", "page_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply(table(spark, sf_dir, "pages"))


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.apply(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.apply(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_html_text": op4_html_text,
    "op5_quality_model": op5_quality_model,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_language": op8_language,
    "language_of_pages": language_of_pages,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_kd_shards": op11_kd_shards,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
