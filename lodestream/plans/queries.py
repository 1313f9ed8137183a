"""One query per operator over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode, media, paths, values
from ..functions.scalars import mixed_seed, normalize_ratios, ratios_to_counts
from ..operators import cache, fields, mixing, nearest, ordering, position, splits, transforms
from ..sources import resolver, sinks
from ..sources.shared import shared_dir, spread
from . import index
from .dialect import to_spark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEED = 42


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def positioned(spark: SparkSession, d: str, name: str) -> DataFrame:
    return position.with_position(read(spark, d, name))


def order_sql(seed: object, *keys: str) -> str:
    return f"md5(concat_ws('-', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), {', '.join(keys)}"


def uniform_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


# --- index, order, slices ---------------------------------------------------------------------


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY {order_sql(SEED, 'o_orderkey')} LIMIT 500")
def index_sql_filter(spark, d):
    sql = "SELECT o_orderkey, o_totalprice FROM dataframe WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
    return index.process_index(read(spark, d, "orders"), sql, SEED, ["o_orderkey"], 500)


@query(f"SELECT c_custkey, c_name FROM customer ORDER BY {order_sql(7, 'c_custkey')} LIMIT 200")
def hash_shuffle_topk(spark, d):
    return ordering.first_rows(read(spark, d, "customer").select("c_custkey", "c_name"), 200, 7, "c_custkey")


_AFFINE = f"""WITH n AS (SELECT count(*) AS n FROM lineitem),
a AS (SELECT min(x) AS a FROM (SELECT 2 * {SEED} + 1 + 2 * i AS x FROM range(10000) r(i)), n WHERE gcd(x, n) = 1)"""


@query(f"{_AFFINE} SELECT i AS pos, (i * (a % n) + {mixed_seed(SEED, 0, 0)} % n) % n AS target FROM range((SELECT n FROM n)) r(i), a, n")
def affine_permutation(spark, d):
    n = read(spark, d, "lineitem").count()
    return spark.range(n).select(F.col("id").alias("pos"), ordering.affine(F.col("id"), n, SEED).alias("target"))


@query(f"{_AFFINE} SELECT i AS pos, (i * (a % n) + {mixed_seed(SEED, 0, 0)} % n) % n AS target FROM range((SELECT n FROM n)) r(i), a, n WHERE i >= 6 * (n // 7)")
def affine_last_split(spark, d):
    n = read(spark, d, "lineitem").count()
    start, end = ordering.affine_split(n, 7, 6)
    return spark.range(start, end).select(F.col("id").alias("pos"), ordering.affine(F.col("id"), n, SEED).alias("target"))


_LINES = "(SELECT *, row_number() OVER () - 1 AS pos FROM lineitem)"


@query(f"SELECT pos, l_orderkey, l_quantity FROM {_LINES} WHERE pos >= 1000 AND pos < 3000")
def parquet_slice(spark, d):
    return position.scan_slice(read(spark, d, "lineitem"), 1000, 3000).select(F.col("_pos").alias("pos"), "l_orderkey", "l_quantity")


@query(f"SELECT pos, l_orderkey, l_quantity FROM {_LINES} WHERE pos >= 17 AND pos < 5000 AND (pos - 17) % 7 = 0")
def parquet_slice_step(spark, d):
    return position.scan_slice(read(spark, d, "lineitem"), 17, 5000, 7).select(F.col("_pos").alias("pos"), "l_orderkey", "l_quantity")


@query(f"SELECT pos, l_orderkey FROM {_LINES} WHERE pos IN (0, 5, 99, 1234, 5999)")
def random_access(spark, d):
    return position.scan_rows(read(spark, d, "lineitem"), (0, 5, 99, 1234, 5999)).select(F.col("_pos").alias("pos"), "l_orderkey")


_ORDERS = "(SELECT *, row_number() OVER () - 1 AS pos, (SELECT count(*) FROM orders) AS n FROM orders)"


@query(f"SELECT pos // (n // 7) AS rank, count(*) AS n_rows, min(pos) AS first, max(pos) AS last FROM {_ORDERS} WHERE pos < 7 * (n // 7) GROUP BY 1")
def rank_slices(spark, d):
    df = positioned(spark, d, "orders")
    rank = position.rank_of(F.col("_pos"), df.count(), 7)
    return df.withColumn("rank", rank).where("rank is not null").groupBy("rank").agg(F.count("*").alias("n_rows"), F.min("_pos").alias("first"), F.max("_pos").alias("last"))


@query(f"SELECT pos % 7 AS rank, count(*) AS n_rows, min(pos) AS first, max(pos) AS last FROM {_ORDERS} WHERE pos < 7 * (n // 7) GROUP BY 1")
def rank_slices_interleaved(spark, d):
    df = positioned(spark, d, "orders")
    rank = position.rank_of(F.col("_pos"), df.count(), 7, interleaved=True)
    return df.withColumn("rank", rank).where("rank is not null").groupBy("rank").agg(F.count("*").alias("n_rows"), F.min("_pos").alias("first"), F.max("_pos").alias("last"))


@query(f"SELECT pos, o_orderkey FROM {_ORDERS} WHERE pos >= 3 * (n // 8) + least(3, n % 8) AND pos < 4 * (n // 8) + least(4, n % 8)")
def partition_scan_balanced(spark, d):
    df = read(spark, d, "orders")
    start, end, step = position.rank_bounds(df.count(), 3, 8, tail="balance")
    return position.scan_slice(df, start, end, step).select(F.col("_pos").alias("pos"), "o_orderkey")


@query("""WITH c AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT key, n, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
t AS (SELECT sum(n)::BIGINT AS total FROM c),
w AS (SELECT i AS node, i * (total // 6) + least(i, total % 6) AS lo, (i + 1) * (total // 6) + least(i + 1, total % 6) AS hi FROM range(6) r(i), t)
SELECT node, key, CAST(CASE WHEN greatest(lo, start) < least(hi, start + n) THEN greatest(lo, start) - start ELSE 0 END AS BIGINT) AS start,
CAST(CASE WHEN greatest(lo, start) < least(hi, start + n) THEN least(hi, start + n) - start ELSE 0 END AS BIGINT) AS "end" FROM w, s""")
def balanced_bounds(spark, d):
    counts = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return position.balanced_bounds(counts, 6)


@query(f"""SELECT CAST(pos // 5000 AS BIGINT) AS chunk, pos, l_extendedprice FROM {_LINES}
QUALIFY row_number() OVER (PARTITION BY pos // 5000 ORDER BY l_extendedprice DESC, pos) <= 3""")
def chunk_scoped_topk(spark, d):
    df = positioned(spark, d, "lineitem").select(F.col("_pos").alias("pos"), "l_extendedprice")
    df = position.by_chunk(df, 5000, read(spark, d, "lineitem").count(), "pos", "chunk")
    w = Window.partitionBy("chunk").orderBy(F.desc("l_extendedprice"), "pos")
    return df.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("chunk", "pos", "l_extendedprice")


@query(f"""SELECT pos, l_quantity FROM {_LINES} WHERE l_quantity > 30
QUALIFY row_number() OVER (PARTITION BY pos // 4000 ORDER BY l_quantity DESC, pos) <= 5""")
def chunk_scoped_sql(spark, d):
    df = positioned(spark, d, "lineitem").select(F.col("_pos").alias("pos"), "l_quantity")
    sql = "SELECT pos, l_quantity FROM dataframe WHERE l_quantity > 30 ORDER BY l_quantity DESC, pos LIMIT 5"
    return index.run_sql_per_chunk(df, sql, 4000, "pos long, l_quantity double", "pos", n=df.count())


@query("""SELECT r AS rank, i AS chunk_id, r * (n // 4) + i * ((n // 4) // p) AS start, r * (n // 4) + (i + 1) * ((n // 4) // p) AS "end"
FROM (SELECT count(*) AS n, ((count(*) // 4) + 699) // 700 AS p FROM orders), range(4) a(r), range(10000) b(i) WHERE i < p""")
def chunk_plan(spark, d):
    return position.chunk_table(spark, read(spark, d, "orders").count(), 4, 700, SEED).select("rank", "chunk_id", "start", "end")


@query(f"""SELECT e AS epoch, c_custkey, row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws('-', CASE e WHEN 0 THEN '{mixed_seed(5, 0, 2)}' ELSE '{mixed_seed(5, 1, 2)}' END, CAST(pos AS VARCHAR))), pos) - 1 AS place
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), range(2) r(e)""")
def epoch_orders(spark, d):
    df = index.materialize(read(spark, d, "customer").select("c_custkey").orderBy("c_custkey"), "customers")
    df = position.with_position(df)
    parts = [ordering.epoch_order(df, 5, e, 2, "_pos", chunk=97).select(F.lit(e).cast("long").alias("epoch"), "c_custkey", F.col("place").cast("long").alias("place")) for e in range(2)]
    return parts[0].unionByName(parts[1])


@query("\nUNION ALL\n".join(f"SELECT CAST({w} AS BIGINT) AS worker, s_suppkey, row_number() OVER (ORDER BY md5(concat_ws('-', '{mixed_seed(9, 0, w)}', CAST(s_suppkey AS VARCHAR))), s_suppkey) - 1 AS place FROM supplier" for w in range(3)))
def unaligned_workers(spark, d):
    df = read(spark, d, "supplier").select("s_suppkey")
    out = None
    for w in range(3):
        part = ordering.epoch_order(df, 9, 0, w, "s_suppkey").select(F.lit(w).cast("long").alias("worker"), "s_suppkey", F.col("place").cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order_sql(mixed_seed(SEED, 1, 0), 'o_orderkey')}) - 1 AS place FROM orders) WHERE place >= 700 AND place < 1000")
def resume_offset(spark, d):
    placed = ordering.epoch_order(read(spark, d, "orders").select("o_orderkey"), SEED, 1, 0, "o_orderkey", chunk=500)
    return placed.where("place >= 700 and place < 1000").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT e AS epoch, count(*) AS n_rows, CAST(sum(s_suppkey) AS BIGINT) AS key_sum FROM supplier, range(4) r(e) GROUP BY 1")
def repeated_epochs(spark, d):
    source = index.StreamingSource(spark, f"{d}/supplier.parquet", key="s_suppkey", shuffle_seed=SEED, lazy=True, chunk_size=100)
    return source.repeated(4).groupBy("epoch").agg(F.count("*").alias("n_rows"), F.sum("s_suppkey").alias("key_sum"))


# --- sources and paths ------------------------------------------------------------------------


_PATHS = """(SELECT page_id, '/data/set' || CAST(page_id % 3 AS VARCHAR) || '/img' || CAST(page_id AS VARCHAR) || '.jpg' AS path FROM pages
UNION ALL SELECT page_id, '/data/set' || CAST(page_id % 3 AS VARCHAR) || '/img' || CAST(page_id AS VARCHAR) || '.txt' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, '/data/meta/img' || CAST(page_id AS VARCHAR) || '.info.json' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, '/data/meta/other' || CAST(page_id AS VARCHAR) || '.txt' FROM pages)"""


@query(f"""SELECT regexp_extract(path, '([^/.]*)[.][^/]*$', 1) AS "index", max(CASE WHEN path LIKE '%.jpg' THEN path END) AS jpg, max(CASE WHEN path LIKE '%.txt' THEN path END) AS txt, max(CASE WHEN path LIKE '%.json' THEN path END) AS info
FROM {_PATHS} WHERE path NOT LIKE '%other%' GROUP BY 1""")
def files_to_index_pivot(spark, d):
    pages = read(spark, d, "pages").select("page_id")
    name = lambda folder, stem, ext: F.concat(folder, F.lit(stem), F.col("page_id").cast("string"), F.lit(ext))
    own = F.concat(F.lit("/data/set"), (F.col("page_id") % 3).cast("string"), F.lit("/"))
    files = pages.select(name(own, "img", ".jpg").alias("path")).unionAll(pages.where("page_id % 2 = 0").select(name(own, "img", ".txt")))
    files = files.unionAll(pages.where("page_id % 5 = 0").select(name(F.lit("/data/meta/"), "img", ".info.json"))).unionAll(pages.select(name(F.lit("/data/meta/"), "other", ".txt")))
    return resolver.files_to_index(files, "image").withColumnRenamed("info.json", "info")


_URL = r"regexp_replace(url, '[?#].*$', '')"


@query(f"""SELECT page_id, regexp_extract({_URL}, '([^/]*)$', 1) AS base, regexp_extract({_URL}, '[^/.]+([.][^./]*)$', 1) AS ext,
regexp_extract(regexp_replace({_URL}, '/+$', ''), '([^/.]*)[^/]*$', 1) AS key,
regexp_extract(url, '^([a-z]+):', 1) || '-' || replace(regexp_extract(regexp_replace({_URL}, '/+$', ''), '([^/]+/[^/]+)$', 1), '/', '-') AS path_key FROM pages""")
def path_keys(spark, d):
    url = F.regexp_replace("url", "[?#].*$", "")
    return read(spark, d, "pages").select("page_id", paths.basename(url).alias("base"), paths.extension(url).alias("ext"), paths.file_key(url).alias("key"), paths.path_key(url).alias("path_key"))


@query("SELECT page_id, '/cache/pages/' || CAST(page_id AS VARCHAR) || '-url' || lower(regexp_extract(url, '[^/.]+([.][^./]*)$', 1)) AS destination FROM pages")
def cache_paths(spark, d):
    return read(spark, d, "pages").select("page_id", paths.cache_path("/cache/", "pages", F.col("page_id"), "url", F.col("url")).alias("destination"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def row_counts(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("SELECT count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM lineitem)")
def file_row_counts(spark, d):
    counts = position.file_counts(read(spark, d, "orders")).unionByName(position.file_counts(read(spark, d, "lineitem")))
    return counts.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"))


# --- fields -----------------------------------------------------------------------------------


_LABELLED = "(SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE d.lang END AS lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def _labelled(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("lang"), "quality")


@query(f"SELECT doc_id, lang, quality FROM {_LABELLED} WHERE lang IS NOT NULL AND lang <> '' AND quality IS NOT NULL")
def required_columns_strict(spark, d):
    return fields.required_columns(_labelled(spark, d), ["lang", "quality"])


@query(f"SELECT doc_id, lang, quality FROM {_LABELLED} WHERE (lang IS NOT NULL AND lang <> '') OR quality IS NOT NULL")
def required_columns_lenient(spark, d):
    return fields.required_columns(_labelled(spark, d), ["lang", "quality", "absent"], allow_missing=True)


@query("""SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END) IS NULL OR (CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END) = '' AS type_dummy,
CASE WHEN event_id % 3 = 0 THEN 'NaN'::DOUBLE ELSE value END IS NULL OR isnan(CASE WHEN event_id % 3 = 0 THEN 'NaN'::DOUBLE ELSE value END) AS value_dummy FROM events""")
def dummy_flags(spark, d):
    df = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("t"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return df.select("event_id", values.is_dummy(df, "t").alias("type_dummy"), values.is_dummy(df, "v").alias("value_dummy"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), CAST(user_id AS VARCHAR)) AS found FROM events")
def coalesce_non_dummy(spark, d):
    df = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")).alias("a"), F.col("user_id").cast("string").alias("b"))
    return fields.first_real_field(df, ["a", "missing", "b"], "found").select("event_id", "found")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS code FROM orders""")
def dictionary_encode(spark, d):
    classes = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return fields.encode_classes(read(spark, d, "orders"), "o_orderpriority", "code", classes, strict=False).select("o_orderkey", "code")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS type_id FROM part")
def dictionary_encode_join(spark, d):
    parts = read(spark, d, "part")
    names = parts.select(F.col("p_type").alias("name")).distinct()
    classes = names.withColumn("id", (F.row_number().over(Window.orderBy("name")) - 1).cast("long"))  # one row per class
    return fields.encode_classes(parts, "p_type", "type_id", classes).select("p_partkey", "type_id")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS f, CAST(o_orderstatus = 'O' AS INT) AS o, CAST(o_orderstatus = 'P' AS INT) AS p FROM orders""")
def one_hot(spark, d):
    df = fields.encode_classes(read(spark, d, "orders"), "o_orderstatus", "code", ["F", "O", "P"])
    hot = fields.one_hot_field(df, "code", "hot", 3)
    return hot.select("o_orderkey", *[F.col("hot")[i].cast("int").alias(c) for i, c in enumerate("fop")])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_subfield(spark, d):
    df = fields.parse_json(read(spark, d, "events"), "props", "meta", "k long")
    return fields.extract_subfield(df, "meta", "k", "k").select("event_id", "k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_variant(spark, d):
    df = fields.parse_json(read(spark, d, "events"), "props", "meta")
    return fields.extract_subfield(df, "meta", "k", "k").select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey + 100 AS c_nationkey FROM customer")
def merge_struct(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.struct(F.col("c_name"), F.col("c_acctbal"), (F.col("c_nationkey") + 100).alias("c_nationkey")).alias("meta"))
    return fields.merge_struct(df, "meta", "overwrite")


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, 2 AS n_members, c_name AS named FROM customer")
def gather_fields(spark, d):
    df = read(spark, d, "customer")
    df = fields.gather_fields(df, ["c_name", "c_mktsegment"], "members", "list")
    df = fields.gather_fields(df, ["c_name", "c_mktsegment"], "record", "dict")
    df = fields.gather_fields(df, ["c_name", "c_mktsegment"], "map", "map")
    return df.select("c_custkey", F.array_join("members", "/").alias("joined"), F.size("map").alias("n_members"), F.col("record.c_name").alias("named"))


@query("SELECT s_suppkey AS key, s_name AS title, CAST(s_acctbal AS VARCHAR) IS NOT NULL AS has_balance, 'supplier' AS kind, CAST(1 AS BIGINT) AS version FROM supplier")
def rename_and_constants(spark, d):
    df = fields.rename_fields(read(spark, d, "supplier"), {"s_suppkey": "key", "s_name": "title"})
    df = fields.add_constants(df, kind="supplier", version=F.lit(1).cast("long"))
    df = fields.cast_fields(df, s_acctbal="string").withColumn("has_balance", F.col("s_acctbal").isNotNull())
    return fields.filter_fields(df, ["key", "title", "has_balance", "kind", "version"], ["s_nationkey"])


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL")
def ensure_fields(spark, d):
    df = fields.ensure_fields(read(spark, d, "embeddings"), {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}, drop_dummies=True)
    return fields.filter_fields(df, ["vec_id", "label"])


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_discount * 100 AS BIGINT) AS cents FROM lineitem")
def cast_fields(spark, d):
    df = fields.cast_fields(read(spark, d, "lineitem"), l_quantity="long")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round(F.col("l_discount") * 100).cast("long").alias("cents"))


_CHOICE = uniform_sql("'3'", "CAST(doc_id AS VARCHAR)")


@query(f"""SELECT doc_id, CASE WHEN u < 0.5 / w THEN 'lang' WHEN u < (0.5 + 0.3 * s) / w THEN 'source' ELSE 'kind' END AS chosen_source,
CASE WHEN u < 0.5 / w THEN lang WHEN u < (0.5 + 0.3 * s) / w THEN source ELSE 'doc' END AS chosen
FROM (SELECT doc_id, lang, source, {_CHOICE} AS u, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS s, CASE WHEN doc_id % 4 = 0 THEN 0.7 ELSE 1.0 END AS w FROM documents)""")
def weighted_field_choice(spark, d):
    df = read(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), F.lit("doc").alias("kind"))
    return fields.choose_field(df, {"lang": 0.5, "source": 0.3, "kind": 0.2}, "chosen", "doc_id", 3).select("doc_id", "chosen", "chosen_source")


# --- joins ------------------------------------------------------------------------------------


@query("""SELECT DISTINCT o_orderkey, c_name, n_name, r_name, p_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 AND o_orderstatus = 'O'""")
def multi_join(spark, d):
    t = lambda n: read(spark, d, n)
    df = t("lineitem").where("l_quantity >= 45").join(t("orders").where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = df.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select("o_orderkey", "c_name", "n_name", "r_name", "p_name", "s_name").distinct()


@query("SELECT p.page_id, d.doc_id, d.lang FROM pages p JOIN documents d ON CAST(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT) = d.doc_id")
def expression_key_join(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("doc_id"))
    return pages.join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("page_id", "doc_id", "lang")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL")
def anti_join(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 300000")
    return read(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT p_partkey FROM part SEMI JOIN lineitem ON p_partkey = l_partkey AND l_discount > 0.08")
def semi_join(spark, d):
    return read(spark, d, "part").join(read(spark, d, "lineitem").where("l_discount > 0.08"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey").distinct()


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_enrichment(spark, d):
    df = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT 100000 AS low, '^[12]-' AS priority) p WHERE o_totalprice > p.low AND regexp_matches(o_orderpriority, p.priority)")
def params_cross_join(spark, d):
    params = spark.range(1).select(F.lit(100000).alias("low"), F.lit("^[12]-").alias("priority"))
    return read(spark, d, "orders").crossJoin(F.broadcast(params)).where("o_totalprice > low AND regexp_like(o_orderpriority, priority)").select("o_orderkey", "o_totalprice")  # one row


@query("""SELECT e.event_id, (SELECT p.event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 3600000000
ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), p.event_id LIMIT 1) AS nearest FROM events e WHERE e.event_type = 'click'""")
def nearest_in_tolerance(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    clicks, purchases = events.where("event_type = 'click'"), events.where("event_type = 'purchase'")
    return nearest.nearest_join(clicks, purchases, ["user_id"], "t", "t", 3_600_000_000, "event_id", "event_id").select("event_id", "nearest")


# --- aggregates, windows, sets ------------------------------------------------------------------


@query("SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_struct_agg(spark, d):
    df = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), F.length(t["text"]).cast("string")))
    return df.select("conv_id", F.array_join(shown, "|").alias("turns"), F.size("turns").cast("long").alias("n"))


@query("SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(CASE WHEN doc_id % 3 = 0 THEN [lang, source] ELSE [NULL] END) AS word FROM documents)")
def unnest_outer(spark, d):
    df = read(spark, d, "documents").withColumn("words", F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")))
    return df.select("doc_id", "lang", F.explode_outer("words").alias("word"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dedup_keep_one(spark, d):
    df = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return cache.keep_first(df, ["user_id"], [-F.col("value"), "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dialect_qualify(spark, d):
    sql = "SELECT user_id, event_id, event_type FROM dataframe QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"
    return index.run_sql(read(spark, d, "events"), sql)


@query("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def dialect_distinct_on(spark, d):
    customers = read(spark, d, "customer")
    customers.createOrReplaceTempView("customers_in")
    return spark.sql(to_spark("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customers_in ORDER BY c_nationkey, c_acctbal DESC, c_custkey")).drop("c_acctbal")


@query("SELECT n_name, 'dataframe' AS literal, n_nationkey // 4 AS quarter FROM nation WHERE regexp_matches(n_name, 'A')")
def dialect_rewrites(spark, d):
    sql = "SELECT * EXCLUDE (n_nationkey, n_regionkey), 'dataframe' AS literal, n_nationkey // 4 AS quarter FROM dataframe WHERE regexp_matches(n_name, 'A')"
    return index.run_sql(read(spark, d, "nation"), sql).withColumn("quarter", F.col("quarter").cast("int"))


@query("SELECT s_suppkey || '_' || i AS s_suppkey, s_name FROM (SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier), range(1, 4) r(i)")
def repeat_suffix(spark, d):
    return cache.repeat_rows(read(spark, d, "supplier").select("s_suppkey", "s_name"), 3, "s_suppkey")


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_sources(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return a.union(read(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("supplier")))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def concat_by_name(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return resolver.concat([a, read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))])


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_keys(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(read(spark, d, "customer").select("c_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT l_orderkey % 50 AS seed, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def distinct_by_seed(spark, d):
    df = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("seed"), "l_partkey")
    return cache.distinct_by_seed(df, "seed", ["l_partkey"])


@query("SELECT label, count(*) AS n, CAST(round(avg(embedding[1]), 4) AS DOUBLE) AS mean FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label")
def mean_without_nan_rows(spark, d):
    df = read(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    return cache.drop_nan_rows(df, "embedding").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 4).alias("mean"))


@query("SELECT (n + 63) // 64 * 64 AS padded FROM (SELECT count(*) AS n FROM orders)")
def round_up(spark, d):
    return read(spark, d, "orders").agg((F.ceil(F.count("*") / 64) * 64).alias("padded"))


@query("""SELECT doc_id, lower(source) AS source, CONCAT(lang, '-', source) AS tag, CAST(ROUND(n_chars / nullif(doc_id % 5, 0), 3) AS DOUBLE) AS ratio, LEAST(n_chars, 500) AS capped,
split_part(source, 'c', 2) AS tail, text ILIKE '%the%' AS has_the FROM documents WHERE lang IN ('en', 'fr') AND source NOT LIKE '%9' AND source IS NOT NULL""")
def scalar_functions(spark, d):
    df = read(spark, d, "documents").where("lang IN ('en', 'fr') AND source NOT LIKE '%9' AND source IS NOT NULL")
    ratio = F.round(F.try_divide(F.col("n_chars"), F.col("doc_id") % 5), 3).cast("double")
    return df.select("doc_id", F.lower("source").alias("source"), F.concat("lang", F.lit("-"), "source").alias("tag"), ratio.alias("ratio"), F.least("n_chars", F.lit(500)).alias("capped"), F.get(F.split("source", "c"), F.lit(1)).alias("tail"), F.contains(F.lower("text"), F.lit("the")).alias("has_the"))


@query("SELECT doc_id FROM documents WHERE list_bool_or(list_transform(['stupid', 'idiot', 'moron'], lambda p: regexp_matches(lower(text), '\\b' || p || '\\b')))")
def regex_any_match(spark, d):
    transforms.sql_function(spark, "matches_any", "t STRING, patterns ARRAY<STRING>", "BOOLEAN", r"exists(patterns, p -> regexp_like(lower(t), concat('\\b', p, '\\b')))")
    read(spark, d, "documents").createOrReplaceTempView("documents_in")
    return spark.sql("SELECT doc_id FROM documents_in WHERE matches_any(text, array('stupid', 'idiot', 'moron'))")


# --- mixing -----------------------------------------------------------------------------------

#: Groups are the orders' states, in proportion to their numbers; there are as many steps as customers.
_GROUPS = """g AS (SELECT row_number() OVER (ORDER BY o_orderstatus) - 1 AS grp, count(*) AS n FROM orders GROUP BY o_orderstatus),
c AS (SELECT grp, n, CAST(greatest(round_even(n / min(n) OVER (), 0), 1) AS BIGINT) AS k, n / sum(n) OVER () AS ratio FROM g),
e AS (SELECT grp, j, row_number() OVER (ORDER BY grp, j) - 1 AS place, row_number() OVER (ORDER BY j, grp) - 1 AS turn, count(*) OVER () AS size FROM c, range(100000) r(j) WHERE j < k),
i AS (SELECT row_number() OVER () - 1 AS i FROM customer)"""


def _groups(spark, d):
    """Turns and ratios of the groups, one number each, and the number of steps."""
    sizes = [r["count"] for r in read(spark, d, "orders").groupBy("o_orderstatus").count().orderBy("o_orderstatus").collect()]
    ratios = normalize_ratios(sizes)
    return dict(enumerate(ratios_to_counts(ratios))), dict(enumerate(ratios)), read(spark, d, "customer").count()


@query(f'WITH {_GROUPS} SELECT i AS step, CAST(grp AS INT) AS "group" FROM i JOIN e ON place = i % size')
def schedule_consecutive(spark, d):
    counts, _, n = _groups(spark, d)
    return mixing.schedule(spark, n, "consecutive", counts)


@query(f'WITH {_GROUPS} SELECT i AS step, CAST(grp AS INT) AS "group" FROM i JOIN e ON turn = i % size')
def schedule_interleaved(spark, d):
    counts, _, n = _groups(spark, d)
    return mixing.schedule(spark, n, "consecutive_interleaved", counts)


def _shuffled_sql(turn: str) -> str:
    return f"""WITH {_GROUPS}, m AS (SELECT DISTINCT i // size AS m FROM i, e),
o AS (SELECT m * size + row_number() OVER (PARTITION BY m ORDER BY md5(concat_ws('-', '{SEED}', {turn}, CAST(place AS VARCHAR))), place) - 1 AS step, grp FROM m, e)
SELECT step, CAST(grp AS INT) AS "group" FROM o WHERE step < (SELECT count(*) FROM i)"""


@query(_shuffled_sql("CAST(m AS VARCHAR)"))
def schedule_random_order(spark, d):
    counts, _, n = _groups(spark, d)
    return mixing.schedule(spark, n, "random_order", counts, seed=SEED)


@query(_shuffled_sql("'0'"))
def schedule_fixed_random_order(spark, d):
    counts, _, n = _groups(spark, d)
    return mixing.schedule(spark, n, "fixed_random_order", counts, seed=SEED)


@query(f"""WITH {_GROUPS}, w AS (SELECT grp, sum(ratio) OVER (ORDER BY grp) AS upto FROM c), u AS (SELECT i, {uniform_sql(f"'{SEED}'", 'CAST(i AS VARCHAR)')} AS u FROM i)
SELECT i AS step, CAST((SELECT min(grp) FROM w WHERE u < upto) AS INT) AS "group" FROM u""")
def schedule_weighted(spark, d):
    counts, ratios, n = _groups(spark, d)
    return mixing.schedule(spark, n, "random", counts, ratios, SEED)


def _streams():
    return mixing.stream_group([{"name": "orders", "ratio": 2, "batch_size": 16, "mixing_group_id": 0}, {"name": "events", "ratio": 1, "batch_size": 32, "batch_gpu": 16, "mixing_group_id": 0}, {"name": "documents", "ratio": 1, "batch_size": 8, "mixing_group_id": 1}], strategy="custom")


_STEPS = f"""SELECT i AS step, g AS "group", CASE WHEN g = 1 THEN 'documents' WHEN u * 0.75 < 0.5 THEN 'orders' ELSE 'events' END AS stream
FROM (SELECT i, ([0, 1, 0, 0])[CAST(i % 4 AS INT) + 1] AS g, {uniform_sql(f"'{SEED}-0'", 'CAST(i AS VARCHAR)')} AS u FROM range(400) r(i))"""


def _uses(spark, steps=400):
    streams = _streams()
    counts, ratios = mixing.mixing_groups(streams)
    return mixing.accumulate(mixing.pick_streams(mixing.schedule(spark, steps, "consecutive_interleaved", counts, ratios, SEED), streams, SEED), streams)


_UNROLLED = f"""SELECT step, "group", stream, CAST(k - 1 - j AS INT) AS rounds_left, CAST(upto - k + j AS BIGINT) AS use
FROM (SELECT *, sum(k) OVER (PARTITION BY stream ORDER BY step) AS upto FROM (SELECT *, CASE WHEN stream = 'events' THEN 2 ELSE 1 END AS k FROM ({_STEPS}))), range(2) b(j) WHERE j < k"""


@query(_UNROLLED.replace("range(400)", "range((SELECT count(*) FROM customer))"))
def accumulation_rounds(spark, d):
    """As many steps as there are customers."""
    return _uses(spark, read(spark, d, "customer").count())


@query(f"""WITH u AS ({_UNROLLED}),
b AS (SELECT 'orders' AS stream, o_orderkey AS id, p // 16 AS batch_no, p % 16 AS slot, n // 16 AS n_batches FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, (SELECT count(*) FROM orders) AS n FROM orders)
UNION ALL SELECT 'events', event_id, p // 16, p % 16, n // 16 FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, (SELECT count(*) FROM events) AS n FROM events)
UNION ALL SELECT 'documents', doc_id, p // 8, p % 8, n // 8 FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, (SELECT count(*) FROM documents) AS n FROM documents))
SELECT u.step, u.stream, u.rounds_left, CAST(b.slot AS INT) AS slot, b.id FROM u JOIN b ON u.stream = b.stream AND u.use % b.n_batches = b.batch_no""")
def mix_streams(spark, d):
    parts = {}
    for name, key, size in (("orders", "o_orderkey", 16), ("events", "event_id", 16), ("documents", "doc_id", 8)):
        rows = position.with_position(index.materialize(read(spark, d, name).select(F.col(key).alias("id")).orderBy("id"), name))
        parts[name] = mixing.batches(rows, "_pos", size, name)
    return mixing.mix(_uses(spark), parts).select("step", "stream", "rounds_left", "slot", "id")


# --- cache, splits, transforms -----------------------------------------------------------------


_SIZES = "(SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS usage FROM documents)"


@query(f"""SELECT a.doc_id, CAST(a.usage AS BIGINT) AS usage, min(b.doc_id) AS evicted_at, min(b.doc_id) IS NULL AS resident
FROM {_SIZES} a LEFT JOIN {_SIZES} b ON b.usage > a.usage - a.n_chars + 300000 GROUP BY a.doc_id, a.usage""")
def fifo_eviction(spark, d):
    df = read(spark, d, "documents").select("doc_id", "n_chars")
    return cache.eviction(df, "doc_id", "n_chars", 300_000, chunk=300).select("doc_id", "usage", "evicted_at", "resident")


@query("SELECT doc_id AS key, CAST(n_chars + length(source) AS BIGINT) AS total, CAST(n_chars * CAST(doc_id % 2 = 1 AS INT) + length(source) AS BIGINT) AS downloaded FROM documents")
def byte_totals(spark, d):
    docs = read(spark, d, "documents")
    plan = docs.select(F.col("doc_id").alias("key"), F.explode(F.array(F.struct(F.col("n_chars").alias("size"), (F.col("doc_id") % 2 == 0).alias("skip")), F.struct(F.length("source").cast("long").alias("size"), F.lit(False).alias("skip")))).alias("c")).select("key", "c.*")
    return cache.byte_totals(plan, "size")


@query("""SELECT page_id AS key, 'url' AS field, url, '/cache/p/' || CAST(page_id AS VARCHAR) || '-url' || lower(regexp_extract(url, '[^/.]+([.][^./]*)$', 1)) AS destination, page_id % 3 = 0 AS skip FROM pages""")
def fetch_plan(spark, d):
    pages = read(spark, d, "pages")
    there = pages.where("page_id % 3 = 0").select(paths.cache_path("/cache", "p", F.col("page_id"), "url", F.col("url")).alias("path"), F.lit(10).alias("size"))
    return cache.fetch_plan(pages, "page_id", ["url"], "/cache", "p", there).select("key", "field", "url", "destination", "skip")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {order_sql(SEED, 'doc_id')}) <= least(n // 10, 60) AS validation FROM documents, (SELECT count(*) AS n FROM documents)")
def validation_split(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    train, held = splits.split_validation(docs, ["doc_id"], splits.validation_size(docs.count(), 0.1, 60), SEED)
    return train.withColumn("validation", F.lit(False)).unionByName(held.withColumn("validation", F.lit(True)))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {order_sql(SEED, 'doc_id')}) > n - 50 AS validation FROM documents, (SELECT count(*) AS n FROM documents)")
def tail_split(spark, d):
    train, held = splits.split_tail(read(spark, d, "documents").select("doc_id"), ["doc_id"], 50, SEED)
    return train.withColumn("validation", F.lit(False)).unionByName(held.withColumn("validation", F.lit(True)))


@query(r"SELECT doc_id, CAST(i - 1 AS INT) AS place, lines[CAST(i AS INT)] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, 100000) r(i) WHERE i <= len(lines)")
def native_fanout(spark, d):
    split = transforms.explode_parts("text", lambda c: F.split(c, "\n"), "line", "place")
    return split(read(spark, d, "documents")).select("doc_id", "place", "line")


@query("SELECT conv_id, turn, CAST(part AS INT) AS part, part * length(text) AS size FROM conversations, range(1, 3) r(part)")
def generator_fanout(spark, d):
    def parts(row: dict):
        for part in (1, 2):
            yield {"conv_id": row["conv_id"], "turn": row["turn"], "part": part, "size": part * len(row["text"])}

    return transforms.per_row(parts, "conv_id long, turn long, part int, size long")(read(spark, d, "conversations"))


@query("SELECT vec_id, CAST(round(len(embedding)) AS BIGINT) AS width, label * 2 AS doubled FROM embeddings WHERE label <> 3")
def row_transform_skip(spark, d):
    def double(row: dict) -> dict:
        if row["label"] == 3:
            raise ValueError("bad row")
        return {"vec_id": row["vec_id"], "width": len(row["embedding"]), "doubled": row["label"] * 2}

    return transforms.per_row(double, "vec_id long, width long, doubled int", on_error="skip")(read(spark, d, "embeddings"))


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def batch_transform(spark, d):
    upper = transforms.per_batch(lambda b: pd.DataFrame({"c_custkey": b.c_custkey, "c_name": b.c_name.str.upper()}), "c_custkey long, c_name string")
    return transforms.chain(read(spark, d, "customer"), [fields.identity, upper])


@query("SELECT n_nationkey, CAST(i - 1 AS INT) AS place, w[CAST(i AS INT)] AS word FROM (SELECT n_nationkey, string_split(n_name || ' of the world', ' ') AS w FROM nation), range(1, 10) r(i) WHERE i <= len(w)")
def table_function(spark, d):
    transforms.split_words_udtf(spark)
    read(spark, d, "nation").createOrReplaceTempView("nation_in")
    return spark.sql("SELECT n_nationkey, place, word FROM nation_in, LATERAL split_words(concat(n_name, ' of the world'))")


_TURNS = "(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


@query(f"""SELECT conv_id, max(CASE WHEN r = 1 THEN turn END) AS first, max(CASE WHEN r = 2 THEN turn END) AS second
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws('-', '5', CAST(conv_id AS VARCHAR), CAST(i AS VARCHAR))), i) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM {_TURNS}) WHERE n >= 2 GROUP BY conv_id""")
def random_pair(spark, d):
    df = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return transforms.random_pair("turns", "pair", "conv_id", 5)(df).select("conv_id", F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"))


# --- media ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST((w - cw) // 2 AS BIGINT) AS "left", CAST((h - ch) // 2 AS BIGINT) AS top, CAST((w - cw) // 2 + cw AS BIGINT) AS "right", CAST((h - ch) // 2 + ch AS BIGINT) AS bottom
FROM (SELECT *, CASE WHEN w / h > 1.5 THEN CAST(floor(h * 1.5) AS BIGINT) ELSE w END AS cw, CASE WHEN w / h > 1.5 THEN h ELSE CAST(floor(w / 1.5) AS BIGINT) END AS ch
FROM (SELECT p_partkey, p_size * 37 + 64 AS w, p_partkey % 900 + 64 AS h FROM part))""")
def center_crop_geometry(spark, d):
    df = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 64).alias("w"), (F.col("p_partkey") % 900 + 64).alias("h"))
    return df.select("p_partkey", media.center_crop(F.col("w"), F.col("h"), 1.5).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 900 > p_size * 37 THEN 640 ELSE 360 END AS h, CASE WHEN p_partkey % 900 > p_size * 37 THEN 360 ELSE 640 END AS w, abs((p_size * 37 + 64) / (p_partkey % 900 + 64)::DOUBLE - 1.0) > 0.02 AS distorted FROM part")
def resize_geometry(spark, d):
    w, h = F.col("p_size") * 37 + 64, F.col("p_partkey") % 900 + 64
    r = media.target_resolution(w, h, 360, 640, allow_vertical=True)
    return read(spark, d, "part").select("p_partkey", r["h"].alias("h"), r["w"].alias("w"), media.is_distorted(w, h, F.lit(1.0)).alias("distorted"))


@query("""SELECT event_id, CAST(i AS INT) AS frame, CAST(round(least(value / 7 + i * CASE WHEN k > 1 THEN greatest(k / 8.0 - 1 / 8.0, 0) / (k - 1) ELSE 0 END, value) * 1000) AS BIGINT) AS ms
FROM (SELECT event_id, value, CASE WHEN 16 / 8.0 > value THEN greatest(1, CAST(floor(value * 8.0) AS INT)) ELSE 16 END AS k FROM events), range(16) r(i) WHERE i < k""")
def frame_grid(spark, d):
    df = read(spark, d, "events").withColumn("k", media.frame_count(F.col("value"), F.lit(8.0), 16))
    times = media.frame_times(F.col("value") / 7, F.lit(8.0), F.col("k"), F.col("value"))
    return df.select("event_id", F.posexplode(times).alias("frame", "t")).select("event_id", "frame", F.round(F.col("t") * 1000).cast("long").alias("ms"))


@query("""SELECT p_partkey, CAST(round(1000 * greatest(a3, 0)) AS BIGINT) AS start_ms, CAST(round(1000 * least(b3, dur)) AS BIGINT) AS end_ms FROM (SELECT *, a2 + greatest(-a2, 0) AS a3, b2 + greatest(-a2, 0) AS b3 FROM
(SELECT *, a1 - greatest(b1 - dur, 0) AS a2, b1 - greatest(b1 - dur, 0) AS b2 FROM (SELECT *, a - greatest((4.0 - (b - a)) / 2, 0) AS a1, b + greatest((4.0 - (b - a)) / 2, 0) AS b1 FROM
(SELECT p_partkey, 10.0 AS dur, greatest(p_size / 6.0 - 1, 0) AS a, least(p_size / 6.0 + (p_partkey % 30) / 10.0, 10.0) AS b FROM part))))""")
def crop_interval(spark, d):
    c = media.soft_crop(F.col("p_size") / 6.0 - 1, F.col("p_size") / 6.0 + (F.col("p_partkey") % 30) / 10.0, F.lit(4.0), F.lit(10.0))
    return read(spark, d, "part").select("p_partkey", F.round(c["start"] * 1000).cast("long").alias("start_ms"), F.round(c["end"] * 1000).cast("long").alias("end_ms"))


@query("SELECT vec_id, CAST(i - 1 AS INT) AS place, CAST(round(1000 * CASE WHEN i <= len(embedding) THEN embedding[CAST(i AS INT)]::DOUBLE ELSE 0 END) AS BIGINT) AS x FROM embeddings, range(1, 71) r(i)")
def pad_or_trim(spark, d):
    df = read(spark, d, "embeddings")
    padded = media.pad_or_trim(F.col("embedding"), 70)
    return df.select("vec_id", F.posexplode(padded).alias("place", "v")).select("vec_id", "place", F.round(F.col("v").cast("double") * 1000).cast("long").alias("x"))


@query("SELECT vec_id, CAST(round(1000 * (b0 / 127.5 - 1)) AS BIGINT) AS first, CAST(round(1000 * (b1 / 127.5 - 1)) AS BIGINT) AS second FROM (SELECT vec_id, vec_id % 256 AS b0, (vec_id * 7) % 256 AS b1 FROM embeddings)")
def normalize_frames(spark, d):
    df = read(spark, d, "embeddings").withColumn("bytes", F.array((F.col("vec_id") % 256).cast("int"), ((F.col("vec_id") * 7) % 256).cast("int")))
    x = media.normalize_bytes(F.col("bytes"))
    return df.select("vec_id", *[F.round(x[i].cast("double") * 1000).cast("long").alias(n) for i, n in enumerate(("first", "second"))])


@query("""SELECT vec_id, CAST(arg_min(s, struct_pack(m := -m, s := s)) AS INT) AS start FROM (SELECT vec_id, s, round(list_sum(list_transform(embedding[CAST(s + 1 AS INT) : CAST(s + 8 AS INT)], lambda x: abs(x::DOUBLE))), 9) AS m
FROM embeddings, range(57) r(s)) GROUP BY vec_id""")
def loudest_window(spark, d):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", media.loudest_window(doubles, 8).alias("start"))


@query("SELECT vec_id, CAST(round(1000 * (embedding[1]::DOUBLE + embedding[33]::DOUBLE) / 2) AS BIGINT) AS first, list_max(list_transform(embedding, lambda x: abs(x))) < 0.2 AS silent FROM embeddings")
def audio_mono(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    m = media.mono(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)))
    return read(spark, d, "embeddings").select("vec_id", F.round(m[0] * 1000).cast("long").alias("first"), media.is_silent(F.col("embedding"), 0.2).alias("silent"))


@query("SELECT vec_id, CAST(i AS INT) AS token, CAST(round(1000 * CASE WHEN i <= 2 AND i < 4 THEN embedding[CAST(i * 16 + 1 AS INT)]::DOUBLE ELSE 0 END) AS BIGINT) AS x FROM embeddings, range(6) r(i)")
def pad_tokens(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.array(*[F.slice(e, i * 16 + 1, 16) for i in range(4)])
    padded = media.pad_tokens(tokens, F.lit(2), 6, 16)
    df = read(spark, d, "embeddings").select("vec_id", F.posexplode(padded).alias("token", "v"))
    return df.select("vec_id", "token", F.round(F.col("v")[0] * 1000).cast("long").alias("x"))


@query("""SELECT vec_id, CAST(round(1000 * (embedding[1]::DOUBLE + sqrt(-2 * ln(1 - u)) * cos(2 * 3.141592653589793 * v) * exp(embedding[2]::DOUBLE / 2))) AS BIGINT) AS x
FROM (SELECT *, %s AS u, %s AS v FROM embeddings)""" % (uniform_sql("CAST(vec_id AS VARCHAR)", "'u'"), uniform_sql("CAST(vec_id AS VARCHAR)", "'v'")))  # fmt: skip  # noqa: UP031
def sample_latent(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    drawn = media.sample_latent(F.slice(e, 1, 1), F.slice(e, 2, 1), F.array(media.hash_normal(F.col("vec_id"))))
    return read(spark, d, "embeddings").select("vec_id", F.round(drawn[0] * 1000).cast("long").alias("x"))


# --- the three real query shapes ----------------------------------------------------------------


@query(f"""SELECT DISTINCT o_orderkey AS data_id, c_name AS data_url, n_name AS caption, r_name AS audio_caption, p_name AS embedding, s_name AS other FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey JOIN part ON CAST(split_part('part.' || CAST(p_partkey AS VARCHAR), '.', 2) AS BIGINT) = l_partkey JOIN supplier ON CAST(split_part('supp.' || CAST(s_suppkey AS VARCHAR), '.', 2) AS BIGINT) = l_suppkey
ORDER BY {order_sql(11, 'data_id', 'embedding', 'other')}""")
def audio_captions_shape(spark, d):
    t = lambda n: read(spark, d, n)
    spread(spark, t("lineitem").count())
    stem = lambda prefix, c: F.get(F.split(F.concat(F.lit(f"{prefix}."), F.col(c).cast("string")), "[.]"), F.lit(1)).cast("long")
    df = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    df = df.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("part"), stem("part", "p_partkey") == F.col("l_partkey")).join(t("supplier"), stem("supp", "s_suppkey") == F.col("l_suppkey"))
    named = {"o_orderkey": "data_id", "c_name": "data_url", "n_name": "caption", "r_name": "audio_caption", "p_name": "embedding", "s_name": "other"}
    df = df.select(*[F.col(a).alias(b) for a, b in named.items()]).distinct()
    return ordering.shuffled(df, 11, "data_id", "embedding", "other")


@query("""WITH best AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) <= 1),
parts AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS members, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT DISTINCT o_orderkey, l_partkey AS top_part, members, n, n_name FROM orders JOIN best ON best.l_orderkey = o_orderkey JOIN parts ON parts.l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus IS NOT NULL AND o_totalprice >= 50000 AND n >= 2 AND l_quantity > 10 AND c_acctbal > 0 AND o_orderpriority NOT LIKE '5%'""")
def scored_video_shape(spark, d):
    lines = read(spark, d, "lineitem")
    best = cache.keep_first(lines.select("l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [-F.col("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_quantity")
    members = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    parts = lines.groupBy("l_orderkey").agg(members.alias("m")).select("l_orderkey", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("members"), F.size("m").cast("long").alias("n"))
    orders = read(spark, d, "orders").where("o_orderstatus IS NOT NULL AND o_totalprice >= 50000 AND o_orderpriority NOT LIKE '5%'")
    df = orders.join(best.where("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").join(parts.where("n >= 2"), F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.join(read(spark, d, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return df.select("o_orderkey", F.col("l_partkey").alias("top_part"), "members", "n", "n_name").distinct()


@query("""WITH params AS (SELECT 'er' AS word), a AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_acctbal AS score FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1),
b AS (SELECT s_suppkey, s_name, 'supplier', s_acctbal FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount > 0.095) x ON l_suppkey = s_suppkey WHERE l_suppkey IS NULL),
c AS (SELECT p_partkey, p_name, 'part', p_retailprice FROM part WHERE p_size < 10), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT id, name, kind, CAST(round(score, 2) AS DOUBLE) AS score FROM u CROSS JOIN params WHERE score > 100 AND (kind <> 'part' OR NOT contains(lower(name), word))""")
def captioned_images_shape(spark, d):
    t = lambda n: read(spark, d, n)
    a = cache.keep_first(t("customer"), ["c_nationkey", "c_mktsegment"], [-F.col("c_acctbal"), "c_custkey"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("score"))
    b = t("supplier").join(t("lineitem").where("l_discount > 0.095"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("s_suppkey", "s_name", F.lit("supplier"), "s_acctbal")
    c = t("part").where("p_size < 10").select("p_partkey", "p_name", F.lit("part"), "p_retailprice")
    params = spark.range(1).select(F.lit("er").alias("word"))
    u = a.union(b).union(c).crossJoin(F.broadcast(params))  # one row
    return u.where("score > 100 AND (kind <> 'part' OR NOT contains(lower(name), word))").select("id", "name", "kind", F.round("score", 2).alias("score"))


# --- streaming --------------------------------------------------------------------------------


def _streamed(spark, d, name, run, mode="append"):
    """Runs a stream over a table into the shared folder and reads what it wrote."""
    import uuid

    from ..sources.shared import shared_dir, spread
    from ..streaming import state

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = state.read_stream(spark, f"{d}/{name}.parquet*", read(spark, d, name).schema)
    made = run(source)
    state.run_available(made, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.schema(made.schema).parquet(f"{base}/out")


@query("SELECT user_id, CAST(1 AS BIGINT) AS n_kept FROM events GROUP BY user_id")
def stream_dedup(spark, d):
    from ..streaming import state

    out = _streamed(spark, d, "events", lambda s: state.dedup_stream(s.select("user_id", "ts"), ["user_id"], "ts", "40 days"))
    return out.groupBy("user_id").agg(F.count("*").alias("n_kept"))


@query("""SELECT user_id, doc_id AS evicted FROM (SELECT a.user_id, a.event_id AS doc_id FROM (SELECT user_id, event_id, CAST(value AS BIGINT) AS size, sum(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS usage FROM events) a
JOIN (SELECT user_id, sum(CAST(value AS BIGINT)) AS total FROM events GROUP BY 1) t ON a.user_id = t.user_id WHERE t.total > a.usage - a.size + 200)""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def stateful_cache_stream(spark, d):
    from ..streaming import state

    rows = lambda s: s.select("user_id", "event_id", F.floor("value").alias("size"))
    return _streamed(spark, d, "events", lambda s: state.cache_stream(rows(s), "user_id", "event_id", "event_id", "size", 200)).select("user_id", "evicted")


# --- stored sources, sinks and datasets ---------------------------------------------------------


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder for a query's files."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 < 2")
def source_list_file(spark, d):
    """Three index files named by a list file; only the first two are asked for."""
    docs, folder = read(spark, d, "documents").select("doc_id", "lang", "n_chars"), fresh(spark, "listed")
    for i in range(3):
        docs.where(F.col("doc_id") % 3 == i).write.parquet(f"{folder}/{i}.parquet")
    spark.createDataFrame([(f"{folder}/{i}.parquet",) for i in (2, 0, 1)] + [("",)], "path string").coalesce(1).write.text(f"{folder}/split_file_paths.txt")
    return resolver.resolve(spark, f"{folder}/split_file_paths.txt", max_files=2)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def source_wildcard_csv(spark, d):
    """CSV files in folders below, found by a wildcard, with inferred types."""
    customers, folder = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), fresh(spark, "csv")
    for i in range(2):
        sinks.save_csv(customers.where(F.col("c_custkey") % 2 == i), f"{folder}/part{i}", single=i == 0)
    return resolver.resolve(spark, f"{folder}/*.csv").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def source_json_array(spark, d):
    """A document that is one JSON array of records."""
    path = f"{fresh(spark, 'json')}.json"
    read(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)  # 25 rows
    return resolver.resolve(spark, path).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders QUALIFY pos >= 900 AND pos < 1300")
def saved_index_slice(spark, d):
    """An index saved with its position; the slice is a pushed filter on it."""
    ranked = position.with_position(index.materialize(read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), "ranked"), "pos")
    return position.slice_scan(sinks.save_index(ranked, fresh(spark, "index"), position="pos"), 900, 1300, position="pos")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {order_sql(SEED, 'c_custkey')}) <= least(n // 5, 40) AS validation FROM customer, (SELECT count(*) AS n FROM customer)")
def saved_validation(spark, d):
    """Both written parts; a second save without `recompute` leaves them alone."""
    customers, path = read(spark, d, "customer").select("c_custkey"), fresh(spark, "split")
    sinks.save_with_validation(customers, path, ["c_custkey"], 0.2, 40, SEED)
    sinks.save_with_validation(customers.limit(0), path, ["c_custkey"], 0.2, 40, SEED, recompute=False)
    return spark.read.parquet(path).withColumn("validation", F.lit(False)).unionByName(spark.read.parquet(f"{path}-val").withColumn("validation", F.lit(True)))


@query(f"""WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () // 3 AS n FROM orders)
SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('-', '{mixed_seed(SEED, 1, 1)}', CAST(pos - n AS VARCHAR))), pos) - 1 AS place FROM x WHERE pos >= n AND pos < 2 * n)
WHERE place >= 100""")
def dataset_resume(spark, d):
    """The second of three consumers in the second epoch, resumed after 100 samples."""
    source = index.StreamingSource(spark, f"{d}/orders.parquet", key="o_orderkey", shuffle_seed=SEED, columns_to_keep=["o_orderkey"])
    source.load_state_dict({"epoch": 1, "sample_in_epoch": 100})
    return source.plan(1, 3).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT name, n / sum(n) OVER () AS ratio FROM s)
SELECT name, round(ratio, 9) AS ratio, CAST(greatest(round_even(ratio / min(ratio) OVER (), 0), 1) AS BIGINT) AS turns FROM r""")
def segment_ratios(spark, d):
    """Streams in proportion to the customers of each segment: ratios and turns of one meta-iteration, from sums over the segments."""
    sizes = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).count()
    told = values.ratios(sizes, "count")
    return told.select("name", F.round("ratio", 9).alias("ratio"), "turns")


@query("""SELECT p_partkey, CASE WHEN m < 5 THEN CAST(floor(amount * 1024 ** m) AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS bytes
FROM (SELECT p_partkey, p_size, p_partkey % 7 AS m, CASE WHEN p_partkey % 7 IN (0, 5, 6) THEN p_size ELSE p_size + 0.25 * (p_partkey % 4) END AS amount FROM part)""")
def byte_sizes(spark, d):
    """Sizes written with every kind of unit, read as columns."""
    kind = F.col("p_partkey") % 7
    unit = F.get(F.array(*[F.lit(u) for u in ("b", "kb", "MB", "gB", " TB", "", " ")]), kind.cast("int"))
    fraction = F.get(F.array(*[F.lit(x) for x in ("", ".25", ".5", ".75")]), (F.col("p_partkey") % 4).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), F.when(kind.isin(0, 5, 6), "").otherwise(fraction), unit)
    return read(spark, d, "part").select("p_partkey", values.byte_size(text).alias("bytes"))


@query("""SELECT p_partkey, i AS place, CASE WHEN i = 1 THEN p_name ELSE p_name || ' ' || CAST(i AS VARCHAR) END AS caption FROM part, range(1, 10) r(i) WHERE i <= 1 + p_partkey % 3""")
def own_table_function(spark, d):
    """A user's generator, registered under a name and called from SQL for every row."""

    def captions(name: str, n: int):
        for i in range(1, n + 1):
            yield i, name if i == 1 else f"{name} {i}"

    transforms.table_function(spark, "captions_of", captions, "place long, caption string")
    read(spark, d, "part").createOrReplaceTempView("parts_to_caption")
    return spark.sql("SELECT p_partkey, c.place, c.caption FROM parts_to_caption, LATERAL captions_of(p_name, CAST(1 + p_partkey % 3 AS INT)) AS c")


@query("""SELECT vec_id, 8000 AS rate, len(embedding) AS n_samples, CAST(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000))) AS BIGINT) AS total FROM embeddings""")
def decode_wav(spark, d):
    """Vectors written as the 16-bit samples of WAV files and decoded again."""
    n = F.size("embedding")
    word = lambda v: F.lpad(F.hex(v.bitwiseAND(0xFFFF)), 4, "0")
    swapped = F.transform("embedding", lambda x: F.concat(F.substring(word(F.floor(x.cast("double") * 1000)), 3, 2), F.substring(word(F.floor(x.cast("double") * 1000)), 1, 2)))
    number = lambda v, size: F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), lambda i: F.substring(F.lpad(F.hex(v), 2 * size, "0"), 2 * i + 1, F.lit(2))), "")
    text = lambda s: F.lit(s.encode().hex())
    header = F.concat(text("RIFF"), number(36 + 2 * n, 4), text("WAVEfmt "), F.lit("10000000" "0100" "0100"), number(F.lit(8000), 4), number(F.lit(16000), 4), F.lit("0200" "1000"), text("data"), number(2 * n, 4))
    audio = read(spark, d, "embeddings").select("vec_id", decode.decode_audio(F.unhex(F.concat(header, F.array_join(swapped, "")))).alias("a"))
    total = F.aggregate(F.col("a.channels")[0], F.lit(0.0), lambda s, x: s + F.round(x.cast("double") * 32768))
    return audio.select("vec_id", "a.rate", F.size(F.col("a.channels")[0]).cast("long").alias("n_samples"), total.cast("long").alias("total"))


@query("""SELECT o_orderkey, (SELECT l_linenumber FROM lineitem WHERE l_orderkey = o_orderkey AND abs((l_linenumber - 1) / 4.0::DOUBLE - (o_orderkey % 9 / 4.0::DOUBLE + 0.05::DOUBLE)) <= 0.126::DOUBLE
ORDER BY abs((l_linenumber - 1) / 4.0::DOUBLE - (o_orderkey % 9 / 4.0::DOUBLE + 0.05::DOUBLE)), l_linenumber LIMIT 1) AS frame FROM orders""")
def seek_frames(spark, d):
    """Lines as frames of four a second; every order asks for the frame at one time."""
    frames = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), "l_linenumber", nearest.index_time(F.col("l_linenumber") - 1, 4.0).alias("pts"))
    requests = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 9 / 4.0 + 0.05).alias("time"))
    return nearest.seek_frames(requests, frames, "clip", "o_orderkey", "time", "l_linenumber", "pts", nearest.exact_tolerance(4.0), strict=False).select("o_orderkey", "frame")


from . import lazy_queries as lazy_queries  # noqa: E402  these register queries of their own
from . import media_queries as media_queries  # noqa: E402
from . import shape_queries as shape_queries  # noqa: E402
from . import source_queries as source_queries  # noqa: E402
from . import state_queries as state_queries  # noqa: E402
