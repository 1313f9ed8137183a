"""Queries of lazy indexes, chunk streams and bounded caches, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import mixed_seed
from ..sources.rowgroups import LazyIndex
from . import index
from .queries import _LINES, SEED, query, read


@query(f"SELECT pos, l_orderkey, line FROM (SELECT pos, l_orderkey, CAST(l_linenumber AS INT) AS line FROM {_LINES}) WHERE pos >= 1234 AND pos < 5432 AND (pos - 1234) % 3 = 0")
def lazy_slice(spark, d):
    """A stepped slice of an index that is neither sorted nor rewritten."""
    rows = LazyIndex.of(read(spark, d, "lineitem")).slice(1234, 5432, 3, ["l_orderkey", "l_linenumber"])
    return rows.select(F.col("_pos").alias("pos"), "l_orderkey", F.col("l_linenumber").cast("int").alias("line"))


@query(f"SELECT pos, l_orderkey, l_quantity FROM {_LINES} WHERE pos IN (SELECT o_orderkey FROM orders)")
def lazy_rows(spark, d):
    """Rows at positions that another table holds, however many."""
    wanted = read(spark, d, "orders").select(F.col("o_orderkey").alias("_pos"))
    return LazyIndex.of(read(spark, d, "lineitem")).rows(wanted, ["l_orderkey", "l_quantity"]).select(F.col("_pos").alias("pos"), "l_orderkey", "l_quantity")


@query(f"SELECT pos // (n // 5) AS rank, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM (SELECT *, count(*) OVER () AS n FROM {_LINES}) WHERE pos < 5 * (n // 5) GROUP BY 1")
def lazy_partitions(spark, d):
    """What each of five consumers reads of a lazy index."""
    lazy, out = LazyIndex.of(read(spark, d, "lineitem")), None
    for rank in range(5):
        part = lazy.partition(rank, 5, ["l_orderkey"]).agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("key_sum")).select(F.lit(rank).cast("long").alias("rank"), "n_rows", "key_sum")
        out = part if out is None else out.unionByName(part)
    return out


def _chunks_sql(table: str, size: int, rank: int, ranks: int, epoch: int) -> str:
    """Numbered rows (pos) of a consumer with their chunk and the place of its first row."""
    return f"""x AS (SELECT *, row_number() OVER () - 1 AS pos, count(*) OVER () // {ranks} AS n FROM {table}),
m AS (SELECT *, n // ((n + {size - 1}) // {size}) AS size FROM (SELECT max(n) AS n FROM x)),
c AS (SELECT i, (row_number() OVER (ORDER BY md5(concat_ws('-', '{mixed_seed(SEED, epoch, rank)}', CAST(i AS VARCHAR))), i) - 1) * size AS tag, {rank} * n + i * size AS lo, {rank} * n + (i + 1) * size AS hi FROM m, range(100000) r(i) WHERE i < (n + {size - 1}) // {size}),
y AS (SELECT x.*, tag FROM x JOIN c ON pos >= lo AND pos < hi)"""


@query(f"""WITH {_chunks_sql('orders', 700, 1, 3, 1)}
SELECT o_orderkey, tag + row_number() OVER (PARTITION BY tag ORDER BY md5(concat_ws('-', '{mixed_seed(SEED, 1, 1)}', CAST(pos AS VARCHAR))), pos) - 1 AS place FROM y QUALIFY place >= 300""")
def lazy_epoch_resume(spark, d):
    """The second of three consumers of a lazy index in the second epoch, resumed after 300 samples: chunks in seeded order, then the rows of each."""
    source = index.StreamingSource(spark, f"{d}/orders.parquet", key="o_orderkey", shuffle_seed=SEED, lazy=True, chunk_size=700)
    source.load_state_dict({"epoch": 1, "sample_in_epoch": 300})
    return source.plan(1, 3).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_chunks_sql('orders', 400, 0, 2, 0)}, best AS (SELECT * FROM y WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY tag ORDER BY o_totalprice DESC, o_orderkey) <= 25)
SELECT o_orderkey, o_totalprice, tag + row_number() OVER (PARTITION BY tag ORDER BY md5(concat_ws('-', '{mixed_seed(SEED, 0, 0)}', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS place FROM best""")
def lazy_sql_per_chunk(spark, d):
    """A query whose order and limit hold in each chunk of a lazy index."""
    sql = "SELECT o_orderkey, o_totalprice FROM dataframe WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
    source = index.StreamingSource(spark, f"{d}/orders.parquet", key="o_orderkey", shuffle_seed=SEED, lazy=True, chunk_size=400, sql=sql, sql_scope="chunk", sql_schema="o_orderkey long, o_totalprice double")
    return source.plan(0, 2).select("o_orderkey", "o_totalprice", F.col("place").cast("long").alias("place"))
