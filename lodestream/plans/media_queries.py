"""Queries of pixels, sound, latents, approximate seeking and resumed mixing over the tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latents, resize, signal, video
from ..operators import mixing, nearest, position
from . import index
from .queries import _UNROLLED, SEED, _streams, query, read


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.bitwiseAND(255)), 2, "0")


def _little(x: Column, size: int) -> Column:
    """A whole number as `size` bytes in hexadecimal, lowest first."""
    return F.concat(*(_byte(F.shiftright(x.cast("long"), 8 * i)) for i in range(size)))


_TENT = lambda at, centre: f"greatest(0, 1 - abs(({at} + 0.5 - {centre}) / 1.6::DOUBLE))"
_AXIS = f"SELECT t, s, {_TENT('s', '((t + 0.5) * 1.6::DOUBLE)')} / sum({_TENT('s', '((t + 0.5) * 1.6::DOUBLE)')}) OVER (PARTITION BY t) * 4194304 + 0.5 AS w FROM range(5) a(t), range(8) b(s)"


@query(f"""WITH px AS (SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(floor((embedding[i + 1]::DOUBLE + 1) * 127) AS BIGINT) & 255 AS v FROM embeddings, range(64) r(i)), ax AS ({_AXIS}),
h AS (SELECT vec_id, y, t AS x, least(255, greatest(0, (CAST(sum(CAST(floor(w) AS BIGINT) * v) AS BIGINT) + 2097152) >> 22)) AS v FROM px JOIN ax ON s = x GROUP BY vec_id, y, t),
z AS (SELECT vec_id, t AS y, x, least(255, greatest(0, (CAST(sum(CAST(floor(w) AS BIGINT) * v) AS BIGINT) + 2097152) >> 22)) AS v FROM h JOIN ax ON s = y GROUP BY vec_id, t, x)
SELECT vec_id, 5 AS height, 5 AS width, string_agg(lpad(upper(printf('%x', v)), 2, '0'), '' ORDER BY y, x) AS pixels FROM z GROUP BY vec_id""")
def resize_pixels(spark, d):
    """Vectors as grey images of 8 x 8, resampled to 5 x 5; the red plane in hexadecimal."""
    grey = F.array_join(F.transform("embedding", lambda v: F.repeat(_byte(F.floor((v.cast("double") + 1) * 127)), F.lit(3))), "")
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(grey).alias("pixels"))
    small = read(spark, d, "embeddings").select("vec_id", resize.fit(image, 5, 5).alias("i"))
    text = F.hex("i.pixels")
    red = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.substring(text, k * 6 + 1, F.lit(2))), "")
    return small.select("vec_id", "i.height", "i.width", red.alias("pixels"))


@query("""SELECT page_id, CASE WHEN h < w THEN 'wide' WHEN h > w THEN 'high' ELSE 'square' END AS shape, CASE WHEN h > w THEN 6 ELSE 4 END AS height, CASE WHEN h > w THEN 4 ELSE 6 END AS width
FROM (SELECT page_id, 4 + page_id % 3 * 2 AS h, 6 AS w FROM pages)""")
def resize_vertical(spark, d):
    """Images with the bytes of pages, cut to the target's shape; upright ones get an upright target."""
    pages = read(spark, d, "pages").withColumn("h", (4 + F.col("page_id") % 3 * 2).cast("int"))
    raw = F.substring(F.concat(F.encode("html", "utf-8"), F.unhex(F.repeat(F.lit("00"), F.lit(200)))), F.lit(1), F.col("h") * 18)
    image = F.struct(F.col("h").alias("height"), F.lit(6).alias("width"), raw.alias("pixels"))
    shape = F.when(F.col("h") < 6, "wide").when(F.col("h") > 6, "high").otherwise("square")
    return pages.select("page_id", shape.alias("shape"), resize.fit(image, 4, 6, allow_vertical=True).alias("i")).select("page_id", "shape", "i.height", "i.width")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS c FROM embeddings)
SELECT vec_id, CAST(32 AS BIGINT) AS n_samples, 0.0::DOUBLE AS tone_left FROM x""")
def resample_audio(spark, d):
    """Every vector as sound with a tone above the lower rate's range added: half the rate keeps half the samples and nothing of the tone."""
    rows = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("float")).alias("plain"))
    tone = F.transform("plain", lambda v, i: (v + F.cos(3.0 * i)).cast("float"))  # 0.48 of the rate
    both = rows.select("vec_id", signal.resample(F.array("plain", tone), F.lit(8000), 4000).alias("c"))
    inside = lambda c: F.slice(c, 9, 16)  # away from the ends, where the tone begins and stops
    left = F.aggregate(F.zip_with(inside(F.col("c")[0]), inside(F.col("c")[1]), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return both.select("vec_id", F.size(F.col("c")[0]).cast("long").alias("n_samples"), F.when(left < 0.05, 0.0).otherwise(left).alias("tone_left"))


@query("SELECT vec_id, -24.0::DOUBLE AS loudness FROM embeddings WHERE list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) >= 0.3")
def normalize_loudness(spark, d):
    """Vectors repeated to a second of sound: silent ones go, the others are brought to -24 LUFS."""
    sound = read(spark, d, "embeddings").select("vec_id", F.array(F.flatten(F.array_repeat("embedding", 125))).alias("c"))
    loud = signal.without_silence(sound, "c", 0.3).withColumn("c", signal.normalize_loudness(F.col("c"), F.lit(8000)))
    return loud.select("vec_id", (F.round(signal.loudness(F.col("c"), F.lit(8000)), 3) + 0.0).alias("loudness"))


def _npy(rows: DataFrame) -> DataFrame:
    """Adds `content`: an npy file of 4 frames of 16 whole numbers, the vector's values in thousandths."""
    head = "{'descr': '<i2', 'fortran_order': False, 'shape': (4, 4, 2, 2), }"
    head += " " * (117 - len(head)) + "\n"
    start = (b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode()).hex()
    body = F.array_join(F.transform("embedding", lambda v: _little(F.floor(v.cast("double") * 1000), 2)), "")
    return rows.withColumn("content", F.unhex(F.concat(F.lit(start), body)))


@query("""SELECT vec_id, '4x4x2x2' AS shape, CAST(list_sum(list_transform(embedding[17:32], lambda v: floor(v::DOUBLE * 1000))) AS BIGINT) AS frame_1, CAST(list_sum(list_transform(embedding[49:64], lambda v: floor(v::DOUBLE * 1000))) AS BIGINT) AS frame_3 FROM embeddings""")
def latent_frames(spark, d):
    """Latents read from npy files; of four latent frames for 32 frames of video, every second one of three from the drawn start."""
    read_ = _npy(read(spark, d, "embeddings")).select("vec_id", F.element_at(latents.load_tensors(F.col("content")), "").alias("t"))
    shape = F.array_join(F.transform("t.shape", lambda x: x.cast("string")), "x")
    frames = latents.clip_frames(F.element_at("t.shape", 1), F.lit(32), 16, 2, F.lit(0.5))  # 2 latent frames at stride 2, start 1
    again = F.concat(frames, F.transform(frames, lambda i: i + 2))
    taken = latents.take_frames(F.col("t"), again)
    total = lambda a: F.aggregate(F.slice(taken, a, 16), F.lit(0.0), lambda s, x: s + x.cast("double")).cast("long")
    return read_.select("vec_id", shape.alias("shape"), total(1).alias("frame_1"), total(17).alias("frame_3"))


_FRAMES = "SELECT l_orderkey AS clip, l_orderkey * 10 + l_linenumber AS frame, (l_linenumber - 1) * 0.25::DOUBLE + (l_partkey % 7) * 0.01::DOUBLE AS pts FROM lineitem"
_ASKED = "SELECT l_orderkey * 10 + l_linenumber AS request, l_orderkey AS clip, (l_linenumber - 1) * 0.25::DOUBLE + (l_suppkey % 11) * 0.02::DOUBLE AS time FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) = 1"


@query(f"""WITH f AS ({_FRAMES}), r AS ({_ASKED})
SELECT request, (SELECT frame FROM f WHERE f.clip = r.clip AND abs(pts - time) <= 0.102::DOUBLE ORDER BY abs(pts - time), pts, frame LIMIT 1) AS frame FROM r""")
def seek_approximate(spark, d):
    """Lines as frames at uneven times; one merge per clip finds the frame nearest to each requested time."""
    lines = read(spark, d, "lineitem")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    beat = (F.col("l_linenumber") - 1) * F.lit(0.25)
    frames = lines.select(F.col("l_orderkey").alias("clip"), number.alias("frame"), (beat + F.col("l_partkey") % 7 * F.lit(0.01)).alias("pts"))
    asked = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")).select(number.alias("request"), F.col("l_orderkey").alias("clip"), (beat + F.col("l_suppkey") % 11 * F.lit(0.02)).alias("time"))
    return nearest.merge_frames(asked, frames, "clip", "request", "time", "frame", "pts", strict=False, cell=0.5).select("request", "frame")


@query(f"""WITH u AS (SELECT * FROM ({_UNROLLED}) WHERE step >= 250),
b AS (SELECT 'orders' AS stream, o_orderkey AS id, p // 16 AS batch_no, p % 16 AS slot, n // 16 AS n_batches FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, (SELECT count(*) FROM orders) AS n FROM orders)
UNION ALL SELECT 'events', event_id, p // 16, p % 16, n // 16 FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, (SELECT count(*) FROM events) AS n FROM events)
UNION ALL SELECT 'documents', doc_id, p // 8, p % 8, n // 8 FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, (SELECT count(*) FROM documents) AS n FROM documents))
SELECT u.step, u.stream, u.rounds_left, CAST(b.slot AS INT) AS slot, b.id FROM u JOIN b ON u.stream = b.stream AND u.use % b.n_batches = b.batch_no""")
def mix_streams_resumed(spark, d):
    """The mix of three streams from step 250 on: the batches used before are counted, not planned again."""
    streams, parts = _streams(), {}
    counts, ratios = mixing.mixing_groups(streams)
    for name, key, size in (("orders", "o_orderkey", 16), ("events", "event_id", 16), ("documents", "doc_id", 8)):
        rows = position.with_position(index.materialize(read(spark, d, name).select(F.col(key).alias("id")).orderBy("id"), name))
        parts[name] = mixing.batches(rows, "_pos", size, name)
    before = mixing.uses_before(spark, streams, 250, "consecutive_interleaved", counts, ratios, SEED)
    steps = mixing.pick_streams(mixing.schedule(spark, 150, "consecutive_interleaved", counts, ratios, SEED, 250), streams, SEED)
    return mixing.mix(mixing.accumulate(steps, streams, before), parts).select("step", "stream", "rounds_left", "slot", "id")


def _avi(rows: DataFrame) -> DataFrame:
    """Adds `content`: an AVI file of a second, the vector's bytes as 4 frames of 2 x 2 pixels (rows from the bottom, blue first, two bytes to fill a row) and again as 64 samples of sound."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    shown = chunk(b"strh", b"vids" + bytes(16) + struct.pack("<IIII", 1, 4, 0, 4) + bytes(20)) + chunk(b"strf", struct.pack("<IiiHH", 40, 2, 2, 1, 24) + bytes(24))
    heard = chunk(b"strh", b"auds" + bytes(52)) + chunk(b"strf", struct.pack("<HHIIHH", 1, 1, 64, 64, 1, 8))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + chunk(b"LIST", b"strl" + shown) + chunk(b"LIST", b"strl" + heard))
    hexed = lambda raw: F.lit(raw.hex())
    part = lambda i: F.array_join(F.transform(F.slice("embedding", 16 * i + 1, 16), lambda v: _byte(F.floor((v.cast("double") + 1) * 127))), "")
    size = struct.pack("<I", 16)
    body = [x for i in range(4) for x in (hexed(b"00db" + size), part(i), hexed(b"01wb" + size), part(i))]
    movie = b"LIST" + struct.pack("<I", 4 + 8 * 24) + b"movi"
    return rows.withColumn("content", F.unhex(F.concat(hexed(b"RIFF" + struct.pack("<I", 4 + len(head) + 12 + 8 * 24) + b"AVI " + head + movie), *body)))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor((v::DOUBLE + 1) * 127) AS BIGINT) & 255) AS b, CASE vec_id % 3 WHEN 2 THEN 1 ELSE 0 END AS f, CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 19 END AS lo, CASE vec_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 35 ELSE 51 END AS hi FROM embeddings)
SELECT vec_id, CAST(f AS INT) AS first_frame, CAST(f + 1 AS INT) AS last_frame, CAST(b[16 * (f + 1) + 11] AS INT) AS red, CAST(list_sum(b[16 * f + 1:16 * f + 6]) + list_sum(b[16 * f + 9:16 * f + 14]) + list_sum(b[16 * f + 17:16 * f + 22]) + list_sum(b[16 * f + 25:16 * f + 30]) AS BIGINT) AS light,
CAST(hi - lo AS BIGINT) AS n_samples, CAST(list_sum(b[lo + 1:hi]) AS BIGINT) AS sound FROM b""")
def video_clips(spark, d):
    """Clips of two frames, with their sound, around an interval of every vector's video: widened, moved into the video, sought and decoded."""
    begin = F.col("vec_id") % 3 * F.lit(0.25)
    crop = F.struct(begin.alias("start"), (begin + 0.1).alias("end"))
    files = _avi(read(spark, d, "embeddings").select("vec_id", "embedding"))
    clips = video.with_clip(files, "content", 2, audio="audio", crop=crop, soft=True)
    text = F.hex("video.pixels")
    byte = lambda i: F.conv(F.substring(text, 2 * i + F.lit(1), F.lit(2)), 16, 10).cast("long")
    light = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(0).cast("long"), lambda a, i: a + byte(i))
    heard = F.col("audio.channels")[0]
    sound = F.aggregate(heard, F.lit(0.0), lambda a, x: a + F.round((x.cast("double") + 1) * 128)).cast("long")
    numbers = F.col("video.numbers")
    return clips.select("vec_id", numbers[0].alias("first_frame"), numbers[1].alias("last_frame"), byte(F.lit(12)).cast("int").alias("red"), light.alias("light"), F.size(heard).cast("long").alias("n_samples"), sound.alias("sound"))


@query("""WITH near AS (SELECT s, i, arg_min(k, [abs(k / 4.0::DOUBLE - i * s / 4.0::DOUBLE), k]) AS frame FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE), (3, 2.0::DOUBLE)) v(m, s), range(4) r(i), range(4) f(k) WHERE i < least(4, floor(4 / s)) GROUP BY s, i),
seen AS (SELECT s, count(DISTINCT frame) AS shown FROM near GROUP BY s)
SELECT vec_id, 4.0::DOUBLE AS fps, 4 AS frames, 2 AS width, 2 AS height, 1.0::DOUBLE AS duration, 64 AS rate, CAST(shown AS INT) AS shown FROM embeddings JOIN seen ON s = 0.25::DOUBLE * 2 ** (vec_id % 4)""")
def video_speeds(spark, d):
    """What every vector's video says of itself, and how many different frames a clip at another speed shows."""
    files = _avi(read(spark, d, "embeddings").select("vec_id", "embedding")).withColumn("i", video.video_info(F.col("content")))
    speed = F.lit(0.25) * F.pow(F.lit(2.0), F.col("vec_id") % 4)
    clips = video.with_clip(files, "content", 4, speedup=speed, real_duration=F.col("i.duration"), real_fps=F.col("i.fps"), allow_shorter=True)
    return clips.select("vec_id", "i.fps", "i.frames", "i.width", "i.height", "i.duration", "i.rate", F.size(F.array_distinct("video.numbers")).alias("shown"))
