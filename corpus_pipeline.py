"""A training corpus in five stages: good texts, one of each near-duplicate group, no repeated passages, no test items, tokens.

Every stage takes and returns the columns of `documents` except the last, which returns the ids of
the tokens. `run` writes each stage's result to the shared folder as Parquet and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontaminate, jaccard_join, quality_model, queries, substring_dedup
from lodestream.llm.tables import keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts to be bad."""
    return quality_model.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_join.representatives(docs, shingle=5, threshold=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 20-word windows that occur earlier; a document of which nothing is left goes."""
    return substring_dedup.cleaned(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.apply(docs, queries.word_bpe(), with_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
