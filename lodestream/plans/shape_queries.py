"""Two training indexes in full: scored clips with sound (two outer unnests, eleven joined tables) and captioned images (five sources, nine-way unions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cache, ordering
from .queries import order_sql, query, read

# --- scored clips -------------------------------------------------------------------------------


def classified_chunks(spark, d) -> DataFrame:
    """(data_id, chunks): every order's line numbers as chunks, with the lines of each as ranked predictions; orders without lines have none."""
    lines = read(spark, d, "lineitem")
    listed = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")))
    chunks = lines.groupBy("l_orderkey", "l_linenumber").agg(listed.alias("p"), F.max("l_quantity").alias("duration"))
    predictions = F.transform("p", lambda x, i: F.struct(i.cast("long").alias("rank"), x["l_partkey"].alias("class_id"), x["l_discount"].alias("probability")))
    nested = chunks.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("chunk_id"), "duration", predictions.alias("predictions"))).alias("chunks"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("data_id")).join(nested.withColumnRenamed("l_orderkey", "data_id"), "data_id", "left")


def top_predictions(meta: DataFrame) -> DataFrame:
    """(data_id, top): the prediction of rank 0 of each chunk, in order of chunks. The filter on rank makes the outer unnests inner."""
    chunks = meta.select("data_id", F.explode_outer("chunks").alias("chunk"))
    best = chunks.select("data_id", "chunk.chunk_id", "chunk.duration", F.explode_outer("chunk.predictions").alias("p")).where("p.rank = 0")
    told = F.struct("chunk_id", "duration", "p.class_id", "p.probability")
    return best.groupBy("data_id").agg(F.array_sort(F.collect_list(told)).alias("top"))


@query(f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_discount) - 1 AS rank, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS duration FROM lineitem),
top AS (SELECT l_orderkey AS data_id, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) AS classes, count(*) AS n_chunks, max(duration) AS longest FROM ranked WHERE rank = 0 GROUP BY 1),
m AS (SELECT l_orderkey AS data_id, count(*) AS n_lines, count(DISTINCT l_suppkey) AS channels, max(l_quantity) AS motion, max(l_discount) * 100 AS aesthetic, min(l_tax) AS dover, max(l_tax) AS lpips, max(l_extendedprice) AS bitrate FROM lineitem GROUP BY 1)
SELECT DISTINCT o_orderkey AS data_id, c_name AS data_url, n_lines AS num_frames, longest AS duration_s, bitrate, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS caption, 200 + o_custkey % 400 AS width, 240 + o_orderkey % 300 AS height,
  channels, n_chunks AS audio_score, classes, motion, aesthetic, dover, lpips
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN m ON m.data_id = o_orderkey JOIN top ON top.data_id = o_orderkey
WHERE n_nationkey % 7 <> 0 AND aesthetic IS NOT NULL AND dover IS NOT NULL AND motion IS NOT NULL AND lpips IS NOT NULL AND o_orderstatus <> 'P' AND least(200 + o_custkey % 400, 240 + o_orderkey % 300) >= 256 AND motion > 10 AND motion < 49
  AND aesthetic >= 3.0 AND lpips >= 0.01 AND dover >= 0.0 AND NOT c_acctbal < -900 AND NOT o_totalprice < 2000 AND o_orderpriority <> '5-LOW' AND n_chunks >= 2 AND c_acctbal >= 100 AND c_mktsegment <> 'MACHINERY' AND channels >= 2 AND bitrate >= 1000""")
def scored_clips_full(spark, d):
    """Eleven tables joined on one key, each scored by a pass of its own; the lines' tables share one exchange, as all are grouped by that key."""
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "data_id")
    keyed = orders.withColumnRenamed("o_orderkey", "data_id")
    customer = read(spark, d, "customer")
    scored = lambda **columns: lines.groupBy("data_id").agg(*(c.alias(k) for k, c in columns.items()))
    data = keyed.select("data_id", "o_custkey").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("data_url")), "o_custkey").drop("o_custkey")
    sound = keyed.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("data_id", (F.col("c_acctbal") < -900).alias("sound_error"), F.col("c_acctbal").alias("usefulness"), "c_mktsegment")
    chunks = top_predictions(classified_chunks(spark, d))
    tags = F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["chunk_id"].cast("string"), x["class_id"].cast("string"))), ",")
    classes = chunks.select("data_id", tags.alias("classes"), F.size("top").cast("long").alias("audio_score"), F.array_max(F.transform("top", lambda x: x["duration"])).alias("duration_s"))
    nations = keyed.select("data_id", "o_custkey").join(customer, F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    captions = nations.select("data_id", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("caption"))
    video = keyed.select("data_id", (200 + F.col("o_custkey") % 400).alias("width"), (240 + F.col("data_id") % 300).alias("height"), (F.col("o_totalprice") < 2000).alias("video_error"), (F.col("o_orderpriority") != "5-LOW").alias("has_audio"))
    nsfw = keyed.select("data_id", (F.col("o_orderstatus") == "P").cast("int").alias("is_nsfw"))
    others = [
        scored(num_frames=F.count("*"), bitrate=F.max("l_extendedprice")),
        scored(channels=F.countDistinct("l_suppkey")),
        scored(motion=F.max("l_quantity")),
        scored(aesthetic=F.max("l_discount") * 100),
        scored(dover=F.min("l_tax"), lpips=F.max("l_tax")),
    ]
    df = reduce(lambda a, b: a.join(b, "data_id"), [data, sound, classes, captions, video, nsfw, *others])
    df = df.where(
        "caption IS NOT NULL AND aesthetic IS NOT NULL AND dover IS NOT NULL AND motion IS NOT NULL AND lpips IS NOT NULL AND is_nsfw = 0 AND least(width, height) >= 256 AND motion > 10 AND motion < 49 AND aesthetic >= 3.0 AND lpips >= 0.01 AND dover >= 0.0"
        " AND sound_error IS FALSE AND video_error IS FALSE AND has_audio IS TRUE AND audio_score >= 2 AND usefulness >= 100 AND c_mktsegment <> 'MACHINERY' AND channels >= 2 AND bitrate >= 1000"
    )
    columns = ("data_id", "data_url", "num_frames", "duration_s", "bitrate", "caption", "width", "height", "channels", "audio_score", "classes", "motion", "aesthetic", "dover", "lpips")
    return ordering.shuffled(df.select(*columns).distinct(), 5, "data_id")


# --- captioned images ---------------------------------------------------------------------------

_UNSAFE, _PLAIN, _ART, _COLOUR = r"\bsmall\b|\bhot \w+", r"\b(?:nation_1|nation_2)\b", r"\b(?:asia|vector|icon)\b", r"\b(red|blue|green)[ -]?(?:ring|widget)s?\b"
_IMAGE = ("data_id", "media_id", "dataset_name", "caption_30", "caption_77", "caption_256", "height", "width", "aspect_ratio", "score", "nudity", "children", "is_nsfw")


def _matches_any(captions: list[Column], pattern: Column) -> Column:
    """Whether some caption matches; null captions do not."""
    return F.exists(F.array(*captions), lambda c: c.isNotNull() & F.regexp_like(F.lower(c), pattern))


def _image(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    ratio = F.round(F.try_divide(F.col("height"), F.col("width")), 1)
    return df.select(*(c.alias(k) for k, c in columns.items())).withColumn("dataset_name", F.lit(name)).withColumn("aspect_ratio", ratio).select(*_IMAGE)


_SHAPE = lambda h, w: f"{h} AS height, {w} AS width, round({h} / nullif({w}, 0), 1) AS aspect_ratio"
_NINE = lambda extra: " UNION ALL ".join(f"SELECT 'set_{k}/' || CAST(doc_id AS VARCHAR) AS media_id, {extra(k)} FROM documents WHERE doc_id % 9 = {k}" for k in range(9))
_ANY = lambda names, pattern: f"len(list_filter([{names}], lambda x: x IS NOT NULL AND regexp_matches(lower(x), '{pattern}'))) > 0"
_ALL_CAPTIONS = "caption_30, caption_77, caption_256"


@query(f"""WITH flickr AS (SELECT c_custkey AS data_id, 'c' || CAST(c_custkey AS VARCHAR) AS media_id, 'flickr_like' AS dataset_name, c_name AS caption_30, n_name AS caption_77, r_name AS caption_256, {_SHAPE('(100 + c_custkey % 50)', '(80 + c_custkey % 30)')},
    c_acctbal AS score, c_custkey % 11 / 10000.0::DOUBLE AS nudity, c_custkey % 13 = 0 AS children, CAST(c_custkey % 5 = 0 AS INT) AS is_nsfw
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 1000) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND o_orderstatus = 'P') icon ON icon.k = c_custkey WHERE icon.k IS NULL AND c_acctbal >= 500),
getty AS (SELECT s_suppkey, 's' || CAST(s_suppkey AS VARCHAR), 'getty_like', coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_name END, n_name), n_name, r_name, {_SHAPE('(90 + s_suppkey % 40)', 's_suppkey % 20')}, s_acctbal, s_suppkey % 12 / 10000.0::DOUBLE, s_suppkey % 17 = 0, CAST(s_suppkey % 6 = 0 AS INT)
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 AND l_quantity > 49) a ON a.k = s_suppkey
  LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.01 AND l_returnflag = 'R') b ON b.k = s_suppkey WHERE a.k IS NULL AND b.k IS NULL AND s_acctbal >= 450),
newgetty AS (SELECT p_partkey, 'p' || CAST(p_partkey AS VARCHAR), 'getty_new_like', p_name, p_brand, p_type, {_SHAPE('p_size', '(p_size + 1)')}, p_retailprice, p_partkey % 12 / 10000.0::DOUBLE, p_partkey % 19 = 0, CAST(p_partkey % 4 = 0 AS INT)
  FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 5) l ON l_partkey = p_partkey WHERE p_retailprice >= 950 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO') ),
treasure AS (SELECT o_orderkey, 'o' || CAST(o_orderkey AS VARCHAR), 'treasure_like', c_name, o_orderpriority, n_name, {_SHAPE('(o_orderkey % 90)', '(o_orderkey % 70)')}, o_totalprice, o_orderkey % 13 / 10000.0::DOUBLE, o_orderkey % 23 = 0, CAST(NULL AS INT)
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice >= 450 AND o_orderstatus IN ('F', 'O')),
c30 AS ({_NINE(lambda k: f"source || ' {k}' AS caption")}), c77 AS ({_NINE(lambda k: f"lang || ' {k}' AS caption")}), safe AS ({_NINE(lambda k: f"doc_id % 12 / 10000.0::DOUBLE AS nudity, doc_id % 29 = 0 AS children, {768 if k < 5 else 1024} AS width, {1344 if k < 5 else 1024} AS height")}),
synthetic AS (SELECT d.doc_id, 'd' || CAST(d.doc_id AS VARCHAR), 'synthetic_like', c30.caption, c77.caption, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.source END, d.lang), {_SHAPE('safe.height', 'safe.width')}, CAST(NULL AS DOUBLE), safe.nudity, safe.children, CAST(d.doc_id % 7 = 0 AS INT)
  FROM documents d JOIN c30 ON CAST(d.doc_id AS VARCHAR) = split_part(c30.media_id, '/', 2) JOIN c77 ON CAST(d.doc_id AS VARCHAR) = split_part(c77.media_id, '/', 2) JOIN safe ON CAST(d.doc_id AS VARCHAR) = split_part(safe.media_id, '/', 2)),
base AS (SELECT * FROM flickr UNION ALL SELECT * FROM getty UNION ALL SELECT * FROM newgetty UNION ALL SELECT * FROM treasure UNION ALL SELECT * FROM synthetic)
SELECT data_id, media_id, dataset_name, caption_30, caption_77, caption_256, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width, aspect_ratio, score, nudity, children, is_nsfw FROM base
WHERE caption_30 IS NOT NULL AND caption_77 IS NOT NULL AND caption_256 IS NOT NULL AND nudity < 0.001 AND children IS FALSE AND (is_nsfw IS NULL OR is_nsfw = 0) AND NOT ({_ANY(_ALL_CAPTIONS, _UNSAFE)})
  AND (dataset_name NOT LIKE 'getty%' OR (NOT regexp_matches(lower(caption_30), '{_PLAIN}') AND NOT ({_ANY('caption_77, caption_256', _PLAIN)}) AND NOT ({_ANY(_ALL_CAPTIONS, _ART)}) AND NOT ({_ANY(_ALL_CAPTIONS, _COLOUR)})))
ORDER BY {order_sql(13, 'media_id')}""")
def captioned_images_full(spark, d):
    """Five sources with their joins, anti joins and one row per medium, three nine-way unions, shared filters by parameters, more of them for one family of sources."""
    t = lambda n: read(spark, d, n)
    places = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    number = lambda c, n: (F.col(c) % n).cast("long")
    share = lambda c, n: F.col(c) % n / F.lit(10000.0)
    flag = lambda c, n: (F.col(c) % n == 0).cast("int")
    once = lambda df: cache.keep_first(df, ["media_id"], ["media_id"])

    icons = t("orders").where("o_orderpriority LIKE '%URGENT%' AND o_orderstatus = 'P'")
    flickr = t("customer").where("c_acctbal >= 500").join(places, F.col("n_nationkey") == F.col("c_nationkey")).join(t("orders").where("o_totalprice > 1000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(icons, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    flickr = _image(flickr, "flickr_like", data_id=F.col("c_custkey"), media_id=key("c", "c_custkey"), caption_30=F.col("c_name"), caption_77=F.col("n_name"), caption_256=F.col("r_name"), height=100 + number("c_custkey", 50), width=80 + number("c_custkey", 30), score=F.col("c_acctbal"), nudity=share("c_custkey", 11), children=F.col("c_custkey") % 13 == 0, is_nsfw=flag("c_custkey", 5))

    lines = t("lineitem")
    anti = lambda df, where: df.join(lines.where(where), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    getty = anti(anti(t("supplier").where("s_acctbal >= 450"), "l_discount > 0.09 AND l_tax > 0.07 AND l_quantity > 49"), "l_quantity > 49 AND l_discount < 0.01 AND l_returnflag = 'R'").join(places, F.col("n_nationkey") == F.col("s_nationkey"))
    getty = _image(getty, "getty_like", data_id=F.col("s_suppkey"), media_id=key("s", "s_suppkey"), caption_30=F.coalesce(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")), "n_name"), caption_77=F.col("n_name"), caption_256=F.col("r_name"), height=90 + number("s_suppkey", 40), width=number("s_suppkey", 20), score=F.col("s_acctbal"), nudity=share("s_suppkey", 12), children=F.col("s_suppkey") % 17 == 0, is_nsfw=flag("s_suppkey", 6))

    parts = t("part").where("p_retailprice >= 950 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO')").join(lines.where("l_quantity > 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    newgetty = _image(parts, "getty_new_like", data_id=F.col("p_partkey"), media_id=key("p", "p_partkey"), caption_30=F.col("p_name"), caption_77=F.col("p_brand"), caption_256=F.col("p_type"), height=F.col("p_size").cast("long"), width=F.col("p_size") + F.lit(1).cast("long"), score=F.col("p_retailprice"), nudity=share("p_partkey", 12), children=F.col("p_partkey") % 19 == 0, is_nsfw=flag("p_partkey", 4))

    treasure = t("orders").where("o_totalprice >= 450 AND o_orderstatus IN ('F', 'O')").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    treasure = _image(treasure, "treasure_like", data_id=F.col("o_orderkey"), media_id=key("o", "o_orderkey"), caption_30=F.col("c_name"), caption_77=F.col("o_orderpriority"), caption_256=F.col("n_name"), height=number("o_orderkey", 90), width=number("o_orderkey", 70), score=F.col("o_totalprice"), nudity=share("o_orderkey", 13), children=F.col("o_orderkey") % 23 == 0, is_nsfw=F.lit(None).cast("int"))

    docs = t("documents").select("doc_id", "source", "lang")

    def nine(columns) -> DataFrame:
        return reduce(DataFrame.unionByName, (docs.where(F.col("doc_id") % 9 == k).select(F.concat(F.lit(f"set_{k}/"), F.col("doc_id").cast("string")).alias("_media"), *columns(k)) for k in range(9)))

    c30 = nine(lambda k: [F.concat("source", F.lit(f" {k}")).alias("_c30")])
    c77 = nine(lambda k: [F.concat("lang", F.lit(f" {k}")).alias("_c77")])
    safe = nine(lambda k: [share("doc_id", 12).alias("_nudity"), (F.col("doc_id") % 29 == 0).alias("_children"), F.lit(768 if k < 5 else 1024).cast("long").alias("_width"), F.lit(1344 if k < 5 else 1024).cast("long").alias("_height")])
    synthetic = docs
    for part in (c30, c77, safe):
        synthetic = synthetic.join(part.withColumn("_id", F.get(F.split("_media", "/"), F.lit(1))).drop("_media"), F.col("doc_id").cast("string") == F.col("_id")).drop("_id")
    synthetic = _image(synthetic, "synthetic_like", data_id=F.col("doc_id"), media_id=key("d", "doc_id"), caption_30=F.col("_c30"), caption_77=F.col("_c77"), caption_256=F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), "lang"), height=F.col("_height"), width=F.col("_width"), score=F.lit(None).cast("double"), nudity=F.col("_nudity"), children=F.col("_children"), is_nsfw=flag("doc_id", 7))

    base = reduce(DataFrame.unionByName, (once(x) for x in (flickr, getty, newgetty, treasure, synthetic)))
    params = spark.range(1).select(F.lit(_UNSAFE).alias("unsafe"), F.lit(_PLAIN).alias("plain"), F.lit(_ART).alias("art"), F.lit(_COLOUR).alias("colour"))
    u = base.crossJoin(F.broadcast(params))  # one row
    captions = [F.col(c) for c in ("caption_30", "caption_77", "caption_256")]
    family = ~F.regexp_like(F.lower(captions[0]), F.col("plain")) & ~_matches_any(captions[1:], F.col("plain")) & ~_matches_any(captions, F.col("art")) & ~_matches_any(captions, F.col("colour"))
    good = u.where("caption_30 IS NOT NULL AND caption_77 IS NOT NULL AND caption_256 IS NOT NULL AND nudity < 0.001 AND children IS FALSE AND (is_nsfw IS NULL OR is_nsfw = 0)")
    good = good.where(~_matches_any(captions, F.col("unsafe")) & (~F.col("dataset_name").like("getty%") | family))
    return ordering.shuffled(good.select(*_IMAGE), 13, "media_id")
