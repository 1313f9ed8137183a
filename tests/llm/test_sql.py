"""Every query that has SQL against it in DuckDB: on a table of the generator and on the small corpus with its edge cases."""

import duckdb
import pytest

from lodestream.llm import jaccard_join, quality_rules, substring_dedup, suffix_dedup
from lodestream.llm.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
OPERATORS = {"op1_substring_dedup": substring_dedup.apply, "op2_suffix_dedup": suffix_dedup.apply, "op3_jaccard_join": jaccard_join.apply, "op7_quality_rules": quality_rules.apply}


def told(name, path):
    with duckdb.connect() as db:
        for table in ("documents", "labels", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path if table == 'documents' else f'{D}/{table}.parquet'}'")
        found = db.execute(ORACLE[name])
        return [c[0] for c in found.description], sorted(found.fetchall(), key=str)


def same(df, name, path):
    names, want = told(name, path)
    assert sorted(names) == sorted(df.columns)
    assert sorted([tuple(r) for r in df.select(*names).collect()], key=str) == want


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    same(QUERIES[name](spark, D), name, f"{D}/documents.parquet")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name, corpus_rows, tmp_path):
    """Nulls, empty and long texts, repetitions and line rules; ids are made unique, since SQL knows rows by them."""
    lines = [
        "Home | News | Sport | Contact | More\nA line that says something of its own.\n\nA line that says something of its own.\nshort bit\nends in û\nends in »\nends ”\nends …\n \n",
        "THIS LINE SHOUTS AT ALL OF US\nWe use Cookies on this page.\nwow! so! much! noise!\n# * $ % & one\nÉTÉ EST LÀ OUI\n",
        "Àé x y  z\r\none two\x0bthree\x0cfour " * 6,
        "privacy\npolicy © 2020 copyright 20\nCopyright 2021 by us",
    ]
    texts = list(dict.fromkeys([t for i, t in corpus_rows if i is None or i < 165])) + [t for i, t in corpus_rows if i is not None and i >= 150] + lines
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "documents")
    df.coalesce(1).write.parquet(path)
    same(OPERATORS[name](spark.read.parquet(path)), name, f"{path}/*.parquet")
