"""Queries of listings, fetches, stream options, decoded images and exports over the tables, each with the same result in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.scalars import normalize_ratios, worker_budget
from ..operators import cache, fields, mixing, nearest
from ..sources import connectors, resolver, sinks
from . import index
from .export import ExportConfig, export
from .queries import SEED, fresh, order_sql, query, read


def _text_files(spark, d) -> tuple[str, DataFrame]:
    """A folder with one text file for each source of the documents: source=<name>/part-....txt."""
    folder = fresh(spark, "texts")
    docs = read(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("source").write.partitionBy("source").text(folder)
    return folder, resolver.listing(spark, folder, [".txt"])


def _source(path: Column) -> Column:
    return F.regexp_extract(path, "source=([^/]*)/", 1)


@query("SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1) AS n FROM documents GROUP BY source) WHERE NOT starts_with(source, 'src1') GROUP BY source")
def list_files(spark, d):
    """Files below a folder by extension, in any case, without those whose whole relative path matches a pattern."""
    folder, _ = _text_files(spark, d)
    found = resolver.listing(spark, folder, [".TXT"], ignore="source=src1.*")
    return found.groupBy(_source(F.col("path")).alias("source")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("SELECT source AS key, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS loaded, 0 AS parts FROM documents GROUP BY source")
def fetch_and_load(spark, d):
    """Files copied through temporary names, rows whose file is missing skipped, the copies joined back by key and loaded into a field; nothing unfinished stays."""
    folder, files = _text_files(spark, d)
    there = files.select(_source(F.col("path")).alias("key"), F.col("path").alias("url"))
    lost = there.select(F.concat(F.lit("lost-"), "key").alias("key"), F.concat("url", F.lit(".not-there")).alias("url"))
    target = fresh(spark, "fetched")
    plan = cache.fetch_plan(there.unionByName(lost), "key", ["url"], "/" + target.split(":", 1)[-1].lstrip("/"), "texts")
    done = index.materialize(cache.fetch(plan, retries=1, on_error="skip"), "done")
    samples = fields.load_files(there.select("key").join(done.select("key", "destination", "bytes"), "key"), "destination", "content")
    unfinished = resolver.listing(spark, target).where("path LIKE '%.part'").agg(F.count("*").cast("int").alias("parts"))
    return samples.select("key", "bytes", F.length("content").cast("long").alias("loaded")).crossJoin(F.broadcast(unfinished))  # one row


@query("SELECT source AS path, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def files_data_source(spark, d):
    """The data source for URLs without a Hadoop connector, over files that the tables' texts were written to."""
    _, files = _text_files(spark, d)
    connectors.register(spark)
    urls = ",".join(r.path for r in files.select("path").collect())  # one URL per source of the documents
    found = spark.read.format("lodestream_files").option("urls", urls.replace("file:/", "file:///") if "file:///" not in urls else urls).load()
    return found.select(_source(F.col("path")).alias("path"), F.length("content").cast("long").alias("bytes"))


@query("SELECT pos, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS pos FROM documents) WHERE pos >= 150 AND pos < 170")
def lazy_wildcard(spark, d):
    """Positions in several files found by a wildcard, neither sorted nor rewritten."""
    docs, folder = read(spark, d, "documents").select("doc_id"), fresh(spark, "wild")
    for i in range(2):
        docs.where(F.col("doc_id") % 2 == i).orderBy("doc_id").coalesce(1).write.parquet(f"{folder}/{i}")
    source = index.StreamingSource(spark, f"{folder}/*.parquet", key="doc_id", lazy=True)
    return source.lazy_index.slice(150, 170).select(F.col("_pos").alias("pos"), "doc_id")


@query("""WITH RECURSIVE s AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1), r AS (SELECT name, n, n / sum(n) OVER () AS ratio, row_number() OVER (ORDER BY name) AS i FROM s),
w AS (SELECT list(CAST(ceil(13 * ratio) AS BIGINT) ORDER BY i) AS l FROM r UNION ALL SELECT list_concat(list_append(l[1:list_position(l, list_max(l)) - 1], list_max(l) - 1), l[list_position(l, list_max(l)) + 1:]) FROM w WHERE list_sum(l) > 13)
SELECT name, round(ratio, 9) AS ratio, (SELECT l[r.i] FROM w WHERE list_sum(l) = 13) AS workers, CAST(n // 8 * 8 AS BIGINT) AS batch_size, CAST(n // 8 AS BIGINT) AS batch_gpu, CAST(2 AS BIGINT) AS rounds, n = max(n) OVER () AND i = min(CASE WHEN n = m THEN i END) OVER () AS is_main, CAST(1000000 // 4 AS BIGINT) AS budget
FROM (SELECT *, max(n) OVER () AS m FROM r) r""")
def stream_plan(spark, d):
    """Options of one stream per segment: ratios, workers, batches solved from totals, the main stream, each worker's cache budget; a stream of ratio 0 goes."""
    sizes = [(r.c_mktsegment, r["count"]) for r in read(spark, d, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()]  # five segments
    configs = [{"name": s, "ratio": 0 if s == "BUILDING" else n, "batch_size": n // 8 * 8, "batch_gpu": n // 8} for s, n in sizes]
    streams = mixing.stream_group(configs, world_size=4, drop_unused=True)
    workers, main = mixing.worker_counts(streams, 13), mixing.main_stream(streams).name
    rows = [(s.name, round(x, 9), workers[s.name], s.batch_size, s.batch_gpu, s.num_accum_rounds, s.name == main, worker_budget(1_000_000, 8, 2)) for s, x in zip(streams, normalize_ratios([s.ratio for s in streams]), strict=True)]
    return spark.createDataFrame(rows, "name string, ratio double, workers long, batch_size long, batch_gpu long, rounds long, is_main boolean, budget long")


@query("SELECT p_partkey, length(p_type) % 3 AS class, CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE -1 END AS brand FROM part")
def callable_classes(spark, d):
    """Classes by functions of a column, checked fields before any job."""
    parts = fields.check_fields(read(spark, d, "part"), {"p_partkey": "bigint", "p_type": "string", "p_brand": "string"}, ["class", "brand"])
    parts = fields.encode_classes(parts, "p_type", "class", lambda c: (F.length(c) % 3).cast("long"))
    parts = fields.encode_classes(parts, "p_brand", "brand", lambda c: F.when(c == "Brand#1", 1).when(c == "Brand#2", 2), strict=False)
    return parts.select("p_partkey", "class", F.coalesce("brand", F.lit(-1)).alias("brand"))


@query("""WITH px AS (SELECT vec_id, string_agg(lpad(upper(printf('%x', CAST(floor((v::DOUBLE + 1) * 127) AS BIGINT) & 255)), 2, '0'), '' ORDER BY i) AS plane FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY vec_id)
SELECT vec_id, 8 AS height, 8 AS width, 1 AS frames, 3 AS channels, plane || plane || plane AS planes FROM px""")
def decode_png(spark, d):
    """Vectors written as grey PNG files of 8 x 8, decoded to planes of bytes, as clips of one frame."""
    values = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127).bitwiseAND(255))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat(F.array(F.lit(0).cast("bigint")), F.slice(values, y * 8 + 1, 8))))  # each row begins with its filter
    word = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    # the checksum at a zlib stream's end: two sums modulo 65521
    low = F.aggregate(rows, F.lit(1).cast("bigint"), lambda a, x: (a + x) % 65521)
    high = F.aggregate(rows, F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")), lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")))["b"]
    body = F.concat(F.lit("7801" "01" "4800" "B7FF"), F.array_join(F.transform(rows, lambda x: word(x, 1)), ""), word(high * 65536 + low, 4))
    part = lambda name, data: F.concat(word(F.length(data) / 2, 4), F.lit(name.encode().hex()), data, F.lit("00000000"))
    png = F.concat(F.lit("89504E470D0A1A0A"), part("IHDR", F.lit("00000008" "00000008" "08" "00" "00" "00" "00")), part("IDAT", body), part("IEND", F.lit("")))
    clip = decode.image_as_video(F.col("i"))
    images = read(spark, d, "embeddings").select("vec_id", decode.decode_image(F.unhex(png), planar=True).alias("i")).select("vec_id", clip.alias("c"))
    return images.select("vec_id", "c.height", "c.width", "c.frames", "c.channels", F.hex("c.pixels").alias("planes"))


@query("SELECT l_orderkey * 10 + l_linenumber AS request, l_orderkey * 100 + l_linenumber AS frame FROM lineitem GROUP BY l_orderkey, l_linenumber")
def seek_by_index(spark, d):
    """Frames by their number: the time of number n at four frames a second, within half a frame."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    at = nearest.index_time(F.col("l_linenumber") - 1, 4.0)
    frames = lines.select(F.col("l_orderkey").alias("clip"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("frame"), (at + 0.01).alias("pts"))
    asked = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), F.col("l_orderkey").alias("clip"), at.alias("time"))
    return nearest.seek_frames(asked, frames, "clip", "request", "time", "frame", "pts", nearest.exact_tolerance(4.0)).select("request", "frame")


@query("SELECT count(*) - count(*) % 3 AS n_rows, count(*) - count(*) % 3 AS n_keys, 1 AS seeds FROM supplier")
def random_seed(spark, d):
    """A seed drawn once is every consumer's: together they read each row once, whatever it is. A field made before fetching comes along."""
    tag = lambda df: df.withColumn("tag", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    source = index.StreamingSource(spark, f"{d}/supplier.parquet", key="s_suppkey", shuffle_seed=-1, columns_to_keep=["s_suppkey"], before_fetch=[tag])
    seen = reduce(DataFrame.unionByName, (source.samples(rank, 3).withColumn("seed", F.lit(source.shuffle_seed)) for rank in range(3)))
    return seen.agg(F.count("*").alias("n_rows"), F.countDistinct("tag").alias("n_keys"), F.countDistinct("seed").cast("int").alias("seeds"))


@query(f"""SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY {order_sql(SEED, 'c_custkey')}) <= least(n // 10, 30) AS validation FROM (SELECT *, count(*) OVER () AS n FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 8)
QUALIFY n = n""".replace("count(*) OVER () AS n FROM customer", "0 AS z FROM customer").replace("least(n // 10, 30)", "least(count(*) OVER () // 10, 30)").replace("\nQUALIFY n = n", ""))
def export_query(spark, d):
    """An index exported by a query in the other dialect, with its validation part, from a config."""
    read(spark, d, "customer").createOrReplaceTempView("customers_to_export")
    sql = "SELECT c_custkey, c_acctbal FROM customers_to_export WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 8"
    path = fresh(spark, "export")
    export(spark, ExportConfig.parse({"sql_query": sql, "destination": path, "keys": ["c_custkey"], "val_ratio": 0.1, "max_num_val_rows": 30, "seed": SEED}))
    return spark.read.parquet(path).withColumn("validation", F.lit(False)).unionByName(spark.read.parquet(f"{path}-val").withColumn("validation", F.lit(True)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END, o_orderkey LIMIT 700""")
def dialect_null_order(spark, d):
    """Nulls of an ascending order come last, as in the dialect of index queries."""
    orders = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    return index.run_sql(orders, "SELECT o_orderkey, price FROM dataframe ORDER BY price, o_orderkey LIMIT 700")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def stringified_csv(spark, d):
    """An index saved as one CSV with all columns as text."""
    path = fresh(spark, "strings")
    sinks.save_csv(read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name"), path, single=True)
    return spark.read.csv(path, header=True, schema="s_suppkey string, s_name string")
