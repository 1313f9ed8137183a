"""Pixels, sound and latents against plain versions."""

import io
import json
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.functions import latents, resize, signal

# --- pixels -------------------------------------------------------------------------------------


def slow_axis(row, target, kernel):
    """One line of numbers, pixel by pixel, with weights as whole numbers of 2^-22."""
    shape, half = resize.KERNELS[kernel]
    n, out = len(row), []
    scale = n / target
    wide = max(scale, 1.0)
    for t in range(target):
        centre = (t + 0.5) * scale
        lo, hi = max(0, int(centre - half * wide + 0.5)), min(n, int(centre + half * wide + 0.5))
        w = [float(shape(np.array([(s + 0.5 - centre) / wide]))[0]) for s in range(lo, hi)]
        total = sum(w)
        fixed = [math.trunc(x / total * 2**22 + math.copysign(0.5, x)) for x in w]
        out.append(min(255, max(0, (sum(f * int(row[s]) for f, s in zip(fixed, range(lo, hi), strict=True)) + 2**21) >> 22)))
    return out


@pytest.mark.parametrize("kernel", ["area", "bilinear", "bicubic", "lanczos"])
@pytest.mark.parametrize("shape", [(7, 5, 3, 4), (4, 4, 9, 11), (6, 10, 6, 5), (1, 1, 2, 3), (9, 9, 3, 3)])
def test_resampling(kernel, shape):
    h, w, new_h, new_w = shape
    pixels = np.random.default_rng(h).integers(0, 256, (h, w, 3), dtype=np.uint8)
    rows = np.array([[slow_axis(pixels[y, :, c], new_w, kernel) for c in range(3)] for y in range(h)]).transpose(0, 2, 1) if w != new_w else pixels
    want = np.array([[slow_axis(rows[:, x, c], new_h, kernel) for c in range(3)] for x in range(new_w)]).transpose(2, 0, 1) if h != new_h else rows
    assert np.abs(resize.resized(pixels, new_h, new_w, kernel).astype(int) - want).max() == 0


def test_flat_images_stay_flat_and_area_is_a_mean():
    flat = np.full((13, 8, 3), 77, np.uint8)
    assert all((resize.resized(flat, 5, 20, k) == 77).all() for k in [*resize.KERNELS, "nearest"])
    pixels = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (resize.resized(pixels, 2, 2, "area")[:, :, 0] == [[8, 14], [32, 38]]).all()
    assert (resize.resized(pixels, 2, 2, "nearest")[:, :, 0] == [[15, 21], [39, 45]]).all()


def test_no_aliasing():
    """A grating finer than the target can show becomes even grey; picking pixels alone would keep stripes."""
    stripes = np.tile(np.array([0, 255], np.uint8)[None, :, None], (8, 64, 3))
    assert np.ptp(resize.resized(stripes, 8, 16, "bilinear")[:, 2:-2].astype(int)) <= 2
    assert np.ptp(resize.resized(stripes, 8, 43, "nearest").astype(int)) == 255


def test_fit_columns(spark):
    """Crop to the shape, upright targets, drawn resolutions, planes, nulls and images of the right size."""
    r = np.random.default_rng(1)
    images = [(i, h, w, r.integers(0, 256, (h, w, 3), dtype=np.uint8)) for i, (h, w) in enumerate([(8, 20), (20, 8), (6, 6), (4, 6), (30, 40)])]
    rows = [(i, (h, w, p.tobytes())) for i, h, w, p in images] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, i struct<height:int,width:int,pixels:binary>")
    got = {x.id: x.o for x in df.select("id", resize.fit(F.col("i"), 4, 6, allow_vertical=True).alias("o")).collect()}
    assert got[9] is None or got[9].pixels is None
    wide = images[0][3][:, 4:16]
    assert bytes(got[0].pixels) == resize.resized(wide, 4, 6).tobytes() and (got[0].height, got[0].width) == (4, 6)
    assert (got[1].height, got[1].width) == (6, 4) and bytes(got[1].pixels) == resize.resized(images[1][3][4:16], 6, 4).tobytes()
    assert bytes(got[3].pixels) == images[3][3].tobytes()
    planes = spark.createDataFrame([(i, (h, w, p.transpose(2, 0, 1).tobytes())) for i, h, w, p in images], df.schema)
    flat = {x.id: x.o for x in planes.select("id", resize.fit(F.col("i"), 4, 6, allow_vertical=True, planar=True).alias("o")).collect()}
    assert all(np.array_equal(np.frombuffer(flat[i].pixels, np.uint8).reshape(3, flat[i].height, -1).transpose(1, 2, 0), np.frombuffer(got[i].pixels, np.uint8).reshape(got[i].height, -1, 3)) for i in range(5))
    drawn = df.where("id < 9").select("id", resize.fit(F.col("i"), 5, 5, choices={(16, 16): 0.5, (6, 6): 0.25, (64, 64): 0.25}, key=F.col("id")).alias("o")).collect()
    assert all((x.o.height, x.o.width) in {(16, 16), (6, 6)} if min(images[x.id][1:3]) >= 16 else x.o.height in (5, 6) for x in drawn)
    with pytest.raises(ValueError):
        resize.fit(F.col("i"), 5, 5, choices={(1, 1): 0.5}, key=F.col("id"))
    with pytest.raises(ValueError):
        resize.crop_resize(F.col("i"), F.col("i"), 1, 1, "cubic")


# --- sound --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("rate", "target"), [(48000, 16000), (44100, 48000), (8000, 11025), (16000, 16000)])
def test_sine_sweep(rate, target):
    """Tones below both limits pass unchanged in height and phase; tones above the lower limit vanish."""
    n = rate // 4
    for share in (0.05, 0.2, 0.35, 0.45, 0.6, 0.9, 0.98):
        f = share * max(rate, target) / 2
        if f >= rate / 2:
            continue
        out = signal.resampled(np.sin(2 * np.pi * f * np.arange(n) / rate), rate, target)
        assert len(out) == -(-n * target // rate)
        edge = len(out) // 5
        want = np.sin(2 * np.pi * f * np.arange(len(out)) / target) if f < min(rate, target) / 2 else np.zeros(len(out))
        limit = min(rate, target) / 2
        if not 0.75 * limit < f < 1.2 * limit:  # in between lies the slope of a filter of six zeros
            assert np.abs(out - want)[edge:-edge].max() < 0.02, (rate, target, f)


def test_resampling_by_definition():
    """The polyphase bank against the sum over all samples, one output at a time."""
    x, rate, target = np.random.default_rng(2).normal(size=300), 3, 2
    cut = min(rate, target) * 0.99
    out = signal.resampled(x, 300, 200)
    for k in range(0, 200, 7):
        t = np.clip((np.arange(300) / rate - k / target) * cut, -6, 6)
        assert abs(out[k] - (x * np.sinc(t) * np.cos(t * np.pi / 12) ** 2).sum() * cut / rate) < 1e-5
    assert len(signal.resampled(np.array([]), 3, 2)) == 0


def test_recursive_filter_in_blocks():
    x = np.random.default_rng(3).normal(size=1000)
    b, a, y, z = np.array([0.3, -0.2, 0.1]), np.array([1.0, -1.6, 0.8]), [], [0.0, 0.0]
    for v in x:
        y.append(b[0] * v + z[0])
        z = [b[1] * v - a[1] * y[-1] + z[1], b[2] * v - a[2] * y[-1]]
    for block in (1, 7, 128, 4096):
        assert np.allclose(signal.recursive(x, b, a, block), y, atol=1e-9)


def test_loudness_of_reference_tones():
    """997 Hz at full scale in one channel is -3.01 LUFS, in two 0.0; gates leave silence and soft parts out."""
    t = np.arange(48000 * 4) / 48000
    tone = np.sin(2 * np.pi * 997 * t)
    assert abs(signal.loudness_of([tone], 48000) + 3.01) < 0.02
    assert abs(signal.loudness_of([tone, tone], 48000)) < 0.02
    assert abs(signal.loudness_of([tone / 10], 48000) + 23.01) < 0.02
    assert abs(signal.loudness_of([np.r_[tone, np.zeros(48000 * 8)]], 48000) + 3.01) < 0.35
    assert abs(signal.loudness_of([np.r_[tone, tone / 1000]], 48000) + 3.01) < 0.35
    assert signal.loudness_of([np.zeros(48000)], 48000) == -70 and signal.loudness_of([np.zeros(3)], 48000) == -70
    low = np.sin(2 * np.pi * 25 * t)
    assert signal.loudness_of([low], 48000) < -10  # the high-pass


def test_audio_columns(spark):
    rng = np.random.default_rng(4)
    loud, soft = (rng.normal(size=8000) * 3).tolist(), (rng.normal(size=8000) * 0.01).tolist()
    df = spark.createDataFrame([(0, [loud, soft], 8000), (1, [soft], 8000), (2, [[0.0] * 8000], 8000), (3, None, 8000), (4, [soft], None)], "id int, c array<array<float>>, r int")
    normal = df.withColumn("n", signal.normalize_loudness(F.col("c"), F.col("r"), -24.0)).withColumn("l", signal.loudness(F.col("n"), F.col("r")))
    got = {r.id: r for r in normal.collect()}
    assert abs(got[0].l + 24) < 0.01 and abs(got[1].l + 24) < 0.01 and got[2].l == -70 and max(got[2].n[0]) == 0 and got[3].n is None and got[4].n is None
    assert sorted(r.id for r in signal.without_silence(df, "c", 0.5).collect()) == [0]
    with pytest.raises(Exception, match="silent audio"):
        signal.without_silence(df, "c", 0.5, "fail").collect()
    sizes = df.where("id < 2").select("id", signal.resize(F.col("c"), F.col("r"), 4000).alias("a"), signal.resize(F.col("c"), F.col("r"), 4000, length=5000).alias("b"), signal.resize(F.col("c"), F.col("r"), 4000, F.lit(0.5)).alias("s")).collect()
    assert all({len(x) for x in r.a} == {4000} and {len(x) for x in r.b} == {5000} and {len(x) for x in r.s} == {2000} and r.b[0][-1] == 0 for r in sizes)


# --- latents ------------------------------------------------------------------------------------


def as_safetensors(tensors):
    body, header = b"", {"__metadata__": {"by": "test"}}
    for name, (kind, shape, data) in tensors.items():
        header[name] = {"dtype": kind, "shape": shape, "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body


def test_tensor_files(spark):
    a = np.random.default_rng(5).normal(size=(2, 3, 4)).astype(np.float32)
    files = []
    for save in (lambda f: np.save(f, a), lambda f: np.save(f, np.asfortranarray(a.astype(">f8"))), lambda f: np.savez(f, mean=a, logvar=a * 2), lambda f: np.savez_compressed(f, mean=a)):
        with io.BytesIO() as f:
            save(f)
            files.append(f.getvalue())
    half = (a.astype("<f4").view("<u4") >> 16).astype("<u2")
    files.append(as_safetensors({"mean": ("F32", [2, 3, 4], a.tobytes()), "n": ("I64", [2], np.array([7, -8], "<i8").tobytes()), "bf": ("BF16", [24], half.tobytes())}))
    bad = [b"", b"nonsense" * 4, struct.pack("<Q", 1 << 40) + b"{}", as_safetensors({"x": ("F32", [9], b"123")})[:-3]]
    with io.BytesIO() as f:
        np.save(f, np.array([{"a": 1}], dtype=object), allow_pickle=True)
        bad.append(f.getvalue())
    df = spark.createDataFrame(list(enumerate(files + bad + [None])), "id int, c binary")
    got = {r.id: r.t for r in df.select("id", latents.load_tensors(F.col("c"), strict=False).alias("t")).collect()}
    same = lambda t, want: t.shape == list(want.shape) and np.allclose(t["values"], want.ravel(), rtol=1e-2)
    assert same(got[0][""], a) and same(got[1][""], a) and same(got[2]["mean"], a) and same(got[2]["logvar"], a * 2) and same(got[3]["mean"], a)
    assert same(got[4]["mean"], a) and got[4]["n"]["values"] == [7.0, -8.0] and np.allclose(got[4]["bf"]["values"], a.ravel(), rtol=1e-2)
    assert all(got[i] is None for i in range(5, 11))
    with pytest.raises(Exception, match="only plain numbers"):
        df.where("id = 9").select(latents.load_tensors(F.col("c"))).collect()


def test_clip_latents(spark):
    one = spark.range(1)
    frames = lambda *a, **b: one.select(latents.clip_frames(F.lit(8), F.lit(29), *a, **b).alias("f")).first().f
    assert frames() == list(range(8)) and frames(9) == [0, 1, 2] and frames(9, 2) == [0, 2] and frames(9, 1, F.lit(0.999)) == [5, 6, 7]
    with pytest.raises(Exception, match="too few latent frames"):
        frames(29, 2)
    assert one.select(latents.skip_of(F.lit(30.0), 10.0).alias("s")).first().s == 3
    for fps in (25.0, 5.0):
        with pytest.raises(Exception, match="no whole ratio"):
            one.select(latents.skip_of(F.lit(fps), 10.0)).collect()
    a = np.arange(48, dtype=np.float32).reshape(4, 3, 2, 2)
    tensor = spark.createDataFrame([(5, (list(a.shape), a.ravel().tolist()), (list(a.shape), [-200.0] * 48), (list(a.shape), [0.0] * 48))], "k int, m struct<shape:array<int>,values:array<float>>, v struct<shape:array<int>,values:array<float>>, w struct<shape:array<int>,values:array<float>>")
    row = tensor.select(latents.take_frames(F.col("m"), F.array(F.lit(3), F.lit(1))).alias("t"), latents.sample_clip(F.col("m"), F.col("v"), F.array(F.lit(1)), F.col("k")).alias("s"), latents.sample_clip(F.col("m"), F.col("w"), F.array(F.lit(1)), F.col("k")).alias("n")).first()
    assert row.t == [*a[3].ravel(), *a[1].ravel()] and np.allclose(row.s, a[1].ravel()) and 0.2 < np.std(np.array(row.n) - a[1].ravel()) < 3


def test_long_rows_come_in_small_batches(spark):
    """Workers get sound by bytes: with batches of 10,000 rows they would hold 80 MB of these at once, and copies of it."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 400, 1, 1).select(F.array(F.array_repeat(F.lit(0.5).cast("float"), 50_000)).alias("c"))
    signal.loudness(F.col("c"), F.lit(8000))
    held = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    sizes = [r.n for r in rows.mapInArrow(held, "n long").collect()]
    assert sum(sizes) >= 400 * 200_000 and max(sizes) < 10 << 20
