"""Decoding of images and audio, clips, and scans that skip files."""

import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import decode, media
from lodestream.functions.scalars import worker_budget
from lodestream.operators import fields, nearest, position


def png(pixels, colour, kinds):
    """A PNG of these samples, each line filtered by the kind given for it, in turn."""
    height, width, step = pixels.shape
    flat = pixels.reshape(height, -1).astype(int)
    lines = []
    for y in range(height):
        kind, line = kinds[y % len(kinds)], bytearray()
        for x in range(width * step):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind]) + bytes(line))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def wav(samples, width, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[0])
        w.setsampwidth(width)
        w.setframerate(rate)
        data = samples.T.reshape(-1)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in data))
    return out.getvalue()


@pytest.mark.parametrize("colour,step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(colour, step):
    pixels = np.random.default_rng(colour).integers(0, 256, (7, 5, step), np.uint8)
    got = decode.png_rgb(png(pixels, colour, (0, 1, 2, 3, 4)))
    wanted = np.repeat(pixels[:, :, :1], 3, axis=2) if step < 3 else pixels[:, :, :3]
    assert (got == wanted).all()


def test_image_column(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (3, 4, 3), np.uint8)
    df = spark.createDataFrame([(0, png(pixels, 2, (4,))), (1, None), (2, b"no image")], "id int, content binary")
    rows = df.select("id", decode.decode_image(F.col("content"), planar=True, strict=False).alias("i")).orderBy("id").collect()
    assert (rows[0].i.height, rows[0].i.width, bytes(rows[0].i.pixels)) == (3, 4, pixels.transpose(2, 0, 1).tobytes())
    assert rows[1].i.pixels is None and rows[2].i.pixels is None
    assert df.where("id = 0").select(decode.image_as_video(decode.decode_image(F.col("content"), planar=True)).alias("v")).first().v.frames == 1
    with pytest.raises(Exception):
        df.select(decode.decode_image(F.col("content"))).collect()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav(width):
    full = 2 ** (8 * width - 1)
    low = 0 if width == 1 else -full
    samples = np.random.default_rng(width).integers(low, low + 2 * full, (2, 50))
    rate, got = decode.wav_channels(wav(samples, width))
    assert rate == 8000
    assert np.allclose(got, (samples - (128 if width == 1 else 0)) / full, atol=1e-6)


def test_audio_column(spark):
    samples = np.zeros((1, 100), int)
    samples[0, 40:50] = 16384
    samples[0, 80] = -32768
    df = spark.createDataFrame([("k", wav(samples, 2, 10))], "key string, content binary").select("key", decode.decode_audio(F.col("content")).alias("a"))
    start = {s: df.select(decode.clip_start(F.col("a.channels"), F.col("a.rate"), 1.0, s, F.col("key")).alias("s")).first().s for s in ("start", "random", "max_mean", "max_center")}
    assert start["start"] == 0 and start["max_mean"] == 40 and start["max_center"] == 75 and 0 <= start["random"] <= 90
    cut = df.select(decode.clip(F.col("a.channels"), F.lit(40), F.lit(10)).alias("c")).first().c
    assert cut == [[0.5] * 10]
    assert df.select(decode.clip_start(F.col("a.channels"), F.col("a.rate"), 99.0, "max_mean").alias("s")).first().s == 0
    half = df.select(decode.resample(F.col("a.channels"), F.col("a.rate"), 5).alias("c")).first().c[0]
    assert half == [float(v) / 32768 for v in samples[0, ::2]]
    loud = np.array(df.select(decode.normalize_volume(F.col("a.channels")).alias("c")).first().c[0])
    assert np.isclose(np.sqrt((loud**2).mean()), 10 ** (-24 / 20)) and abs(loud).max() <= 1


def test_loudest_window_edges(spark):
    df = spark.createDataFrame([(0, [1.0] * 6), (1, [0.0, -3.0, 2.0]), (2, [1.0]), (3, []), (4, None)], "id int, x array<double>")
    assert [r.s for r in df.select("id", media.loudest_window(F.col("x"), 2).alias("s")).orderBy("id").collect()] == [0, 1, None, None, None]


def test_scans_read_only_touched_files(spark, tmp_path):
    spark.range(0, 100, 1, 10).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert [r.id for r in position.scan_slice(table, 25, 41, 5).orderBy("_pos").collect()] == [25, 30, 35, 40]
    assert [r.id for r in position.scan_rows(table, [99, 3, 3]).orderBy("_pos").collect()] == [3, 99]
    assert position.scan_slice(table, 200, 300).count() == 0 and position.scan_rows(table, []).count() == 0
    assert [r.id for r in position.scan_slice(table, 5, 95, 30).orderBy("_pos").collect()] == [5, 35, 65]


def test_nearest(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 1.0), (4, None, 1.0), (5, "a", None)], "i int, k string, t double")
    right = spark.createDataFrame([(9, "a", 9.5), (8, "a", 10.5), (7, "b", 3.0), (6, None, 1.0)], "j int, k string, u double")
    got = {r.i: r.nearest for r in nearest.nearest_join(left, right, ["k"], "t", "u", 1.0, "i", "j").collect()}
    assert got == {1: 8, 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(Exception, match="no frame"):
        nearest.seek_frames(left, right, "k", "i", "t", "j", "u", 1.0).collect()


def test_callable_classes(spark):
    df = spark.createDataFrame([("cat",), ("horse",)], "name string")
    assert [r.n for r in fields.encode_classes(df, "name", "n", F.length).orderBy("n").collect()] == [3, 5]
    with pytest.raises(Exception, match="unknown class"):
        fields.encode_classes(df, "name", "n", lambda c: F.when(c == "cat", 1)).collect()


def test_worker_budget():
    assert worker_budget(1000, 8, 2, 4) == 250 and worker_budget(None, 8) is None
    with pytest.raises(ValueError):
        worker_budget(1000, 7, 1, 2)
