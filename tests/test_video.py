"""Video files of known frames and sound, their clips, seeking and errors."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from test_decode import png

from lodestream.functions import video


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames, fps=(10, 1), size=(4, 3), codec=b"\0\0\0\0", bits=24, sound=(), form=(1, 1, 100, 16), palette=b"", more=()):
    """A file of these frame and sound chunks; `more` goes into a second RIFF."""
    width, height = size
    video_head = chunk(b"strh", b"vids" + codec + struct.pack("<IIIIIII", 0, 0, 0, fps[1], fps[0], 0, len(frames)) + bytes(20))
    video_form = chunk(b"strf", struct.pack("<IiiHH4sIIIII", 40, width, height, 1, bits, codec, 0, 0, 0, 0, 0) + palette)
    kind, channels, rate, depth = form
    sound_head = chunk(b"strh", b"auds" + bytes(52))
    sound_form = chunk(b"strf", struct.pack("<HHIIHH", kind, channels, rate, rate * channels * depth // 8, channels * depth // 8, depth))
    lists = chunk(b"LIST", b"strl" + video_head + video_form) + (chunk(b"LIST", b"strl" + sound_head + sound_form) if sound else b"")
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + lists)
    name = b"00db" if codec == b"\0\0\0\0" else b"00dc"
    body = [chunk(name, f) for f in frames]
    for i, s in enumerate(sound):
        body.insert(min(len(body), 2 * i + 1), chunk(b"01wb", s))
    movie = chunk(b"LIST", b"movi" + chunk(b"LIST", b"rec " + body[0]) + b"".join(body[1:]))
    whole = chunk(b"RIFF", b"AVI " + head + chunk(b"JUNK", b"abc") + movie + chunk(b"idx1", bytes(16)))
    return whole + (chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + b"".join(chunk(name, f) for f in more))) if more else b"")


def plain(pixels, bits=24):
    """A bitmap's rows: from the bottom, blue first, filled up to four bytes."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (width * bits // 8 + 3) // 4 * 4), np.uint8)
    body = pixels[::-1, :, ::-1] if bits == 24 else np.concatenate([pixels[::-1, :, ::-1], np.zeros((height, width, 1), np.uint8)], 2)
    rows[:, : width * bits // 8] = body.reshape(height, -1)
    return rows.tobytes()


R = np.random.default_rng(5)
SHOTS = R.integers(0, 256, (12, 3, 5, 3), dtype=np.uint8)


@pytest.mark.parametrize("bits", [24, 32])
def test_plain_pixels(bits):
    v = video.open_video(avi([plain(x, bits) for x in SHOTS], size=(5, 3), bits=bits))
    assert (v.fps, len(v.frames), v.width, v.height) == (10.0, 12, 5, 3)
    assert all((v.pixels(i) == SHOTS[i]).all() for i in range(12))


def test_rows_from_the_top_palettes_and_repeated_frames():
    top = video.open_video(avi([plain(x[::-1]) for x in SHOTS], size=(5, -3)))
    assert all((top.pixels(i) == SHOTS[i]).all() for i in range(12))
    colours = R.integers(0, 256, (6, 4), dtype=np.uint8)
    index = R.integers(0, 6, (3, 5), dtype=np.uint8)
    rows = np.zeros((3, 8), np.uint8)
    rows[:, :5] = index[::-1]
    v = video.open_video(avi([rows.tobytes(), b"", b""], size=(5, 3), bits=8, palette=colours.tobytes()))
    assert all((v.pixels(i) == colours[index][:, :, 2::-1]).all() for i in range(3))


def test_frames_of_png_and_a_second_riff():
    files = [png(x, 2, [0, 1, 2, 3, 4]) for x in SHOTS]
    v = video.open_video(avi(files[:7], size=(5, 3), codec=b"MPNG", more=files[7:]))
    assert len(v.frames) == 12 and all((v.pixels(i) == SHOTS[i]).all() for i in range(12))


def test_planar_yuv():
    """Black, white, grey and the primary colours, by the values that the standard gives them."""
    for (y, u, v), rgb in {(16, 128, 128): (0, 0, 0), (235, 128, 128): (255, 255, 255), (126, 128, 128): (128, 128, 128), (81, 90, 240): (254, 0, 0), (145, 54, 34): (0, 255, 1), (41, 240, 110): (0, 0, 255)}.items():
        raw = bytes([y]) * 15 + bytes([u]) * 6 + bytes([v]) * 6  # 5 x 3, chroma 3 x 2
        out = video.open_video(avi([raw], size=(5, 3), codec=b"I420", bits=12)).pixels(0)
        assert out.shape == (3, 5, 3) and (np.abs(out.astype(int) - rgb) <= 1).all()


@pytest.mark.parametrize("depth", [8, 16, 24])
def test_sound_is_cut_to_the_sample(depth):
    n = 250
    raw = R.integers(0, 256, n * 2 * depth // 8, dtype=np.uint8).tobytes()
    cuts = [0, 30, 30, 142, 1, len(raw)]  # chunks need not hold whole samples
    parts = [raw[a:b] for a, b in zip(sorted(cuts), sorted(cuts)[1:], strict=False)]
    v = video.open_video(avi([plain(x) for x in SHOTS], size=(5, 3), sound=parts, form=(1, 2, 100, depth)))
    step = depth // 8
    value = lambda i: (raw[i] - 128) / 128 if step == 1 else int.from_bytes(raw[i : i + step], "little", signed=True) / 2 ** (depth - 1)
    whole = np.array([[value((i * 2 + c) * step) for i in range(n)] for c in (0, 1)])
    for start, end in ((0.0, None), (0.3, 1.25), (0.999, 1.001), (2.0, 9.0)):
        got = v.waveform(start, end)
        assert np.allclose(got, whole[:, int(start * 100) : n if end is None else min(n, int(end * 100))], atol=1e-6)
    assert v.waveform(2.6, 3.0).shape == (1, 0)
    silent = video.open_video(avi([plain(x) for x in SHOTS], size=(5, 3)))
    assert silent.waveform(0.0, None).shape == (1, 0)


def test_seeking():
    assert video.frames_near([0.0, 0.05, 0.051, 0.14, 1.1], 12, 10.0) == [0, 0, 1, 1, 11]
    for late in ([1.16], [0.2, 0.1]):
        with pytest.raises(ValueError):
            video.frames_near(late, 12, 10.0)
    assert video.frames_near([1.16, 1.2], 12, 10.0, approximate=True) == [11, 11]
    with pytest.raises(ValueError):
        video.frames_near([1.21], 12, 10.0, approximate=True)
    with pytest.raises(ValueError):
        video.open_video(b"RIFF1234WAVE")


@pytest.fixture
def files(spark):
    sound = np.arange(240, dtype="<i2") * 100
    with_sound = avi([plain(x) for x in SHOTS], size=(5, 3), sound=[sound.tobytes()], form=(1, 1, 200, 16))
    still = avi([plain(x) for x in SHOTS[:3]], size=(5, 3), sound=[bytes(40)], form=(1, 1, 200, 16))
    return spark.createDataFrame([(1, with_sound), (2, still), (3, b"no video"), (4, None), (5, with_sound[:-90])], "id int, content binary").repartition(2)


def test_clips_and_their_sound(files):
    crop = F.struct(F.lit(0.5).alias("start"), F.lit(0.6).alias("end"))
    out = {r.id: r for r in video.with_clip(files, "content", 4, audio="sound", strict=False, crop=crop, soft=True).collect()}
    one = out[1]
    assert np.allclose(one.frame_times, [0.35, 0.45, 0.55, 0.65]) and abs(one.clip_duration - 0.4) < 1e-9
    assert one.video.numbers == [int(np.ceil(t * 10 - 0.5)) for t in one.frame_times]
    got = np.frombuffer(one.video.pixels, np.uint8).reshape(4, 3, 3, 5)
    assert all((got[k] == SHOTS[i].transpose(2, 0, 1)).all() for k, i in enumerate(one.video.numbers))
    assert one.sound.rate == 200 and np.allclose(np.array(one.sound.channels[0]) * 32768, np.arange(70, 150) * 100, atol=1)
    assert all(out[i].video is None for i in (2, 3, 4))


def test_short_videos_rates_draws_and_silence(files):
    known = files.where("id < 3")
    short = {r.id: r for r in video.with_clip(known, "content", 4, allow_shorter=True).collect()}
    assert short[2].video.numbers == [0, 1, 2] and short[1].video.numbers == [0, 1, 2, 3]
    slow = {r.id: r.video.numbers for r in video.with_clip(known.where("id = 1"), "content", 3, framerate=10, speedup=2.5).collect()}
    assert slow[1] == [0, 2, 5]
    drawn = [video.with_clip(known.where("id = 1"), "content", 2, key=F.col("id"), seed=s).first().video.numbers for s in (1, 1, 2, 3)]
    assert drawn[0] == drawn[1] and len({x[0] for x in drawn}) > 1 and all(b == a + 1 for a, b in drawn)
    told = video.with_clip(known, "content", 2, real_duration=F.lit(0.2), real_fps=F.lit(20.0), audio="sound").collect()
    assert all(r.video.numbers == [0, 1] and len(r.sound.channels[0]) == 20 for r in told)
    loud = video.with_clip(known, "content", 2, audio="sound", silent_below=0.01).collect()
    assert [r.id for r in loud] == [1]


def test_what_cannot_be_given_is_an_error_if_strict(files):
    for bad in (files.where("id = 2"), files.where("id = 3")):
        with pytest.raises(PySparkException):
            video.with_clip(bad, "content", 4).collect()
    hard = F.struct(F.lit(0.0).alias("start"), F.lit(0.1).alias("end"))
    assert video.with_clip(files.where("id = 1"), "content", 4, crop=hard, strict=False).first().video is None
    assert video.with_clip(files.limit(0), "content", 4).collect() == []
    info = {r.id: r.i for r in files.select("id", video.video_info(F.col("content"), strict=False).alias("i")).collect()}
    assert (info[1].frames, info[1].fps, info[1].rate, info[3], info[4]) == (12, 10.0, 200, None, None)
    assert info[5].frames == 10  # a file cut off by its index, a frame of 56 bytes and a part of one gives what it has


def test_frames_and_sound_are_one_pass_over_the_contents(files):
    """With duration and rate from the index, contents go to Python once."""
    df = video.with_clip(files, "content", 2, audio="sound", real_duration=F.lit(1.2), real_fps=F.lit(10.0), strict=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
