"""Clips of frames and sound from video files, inside Arrow batches.

AVI files (also longer than one RIFF) are read with numpy alone where frames are stored as plain
pixels (8 with a palette, 24 or 32 bits), planar YUV (I420) or PNG, and sound as PCM; frames stored
as JPEG need Pillow on the workers. Other codecs are not decoded. What a clip consists of (number
of frames, interval, times) is planned with columns; workers walk over the chunk headers of a file
and decode only the frames that were asked for.

A content that cannot be decoded gives null, an error only where `strict`; so does a time without
a frame. A null content or null times give null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import batched_udf
from ..operators.nearest import BUFFER_S, exact_tolerance
from .decode import AUDIO, _each, image_pixels, pcm_samples
from .media import frame_count, frame_times, hard_crop_ok, soft_crop
from .signal import without_silence
from .values import hash_uniform

INFO = "fps double, frames int, width int, height int, duration double, rate int, channels int"
CLIP = "frames int, channels int, height int, width int, pixels binary, numbers array<int>"


@dataclass
class Video:
    """Where the chunks of a file are, and how to read them."""

    data: memoryview
    fps: float = 0.0
    width: int = 0
    height: int = 0
    upside_down: bool = True
    bits: int = 0
    codec: bytes = b""
    palette: np.ndarray | None = None
    frames: list[tuple[int, int]] = field(default_factory=list)
    rate: int = 0
    channels: int = 0
    sample_bytes: int = 0
    floats: bool = False
    sound: list[tuple[int, int]] = field(default_factory=list)

    def pixels(self, i: int) -> np.ndarray:
        """Frame i as height x width x 3 bytes. An empty chunk repeats the frame before it."""
        while i > 0 and not self.frames[i][1]:
            i -= 1
        start, size = self.frames[i]
        raw = self.data[start : start + size]
        if self.codec in (b"MPNG", b"PNG ", b"MJPG", b"mjpg"):
            return image_pixels(bytes(raw))
        if self.codec in (b"I420", b"IYUV"):
            return _from_yuv(np.frombuffer(raw, np.uint8), self.width, self.height)
        if self.codec not in (b"\0\0\0\0", b"DIB ") or self.bits not in (8, 24, 32):
            raise ValueError(f"frames are stored as {self.codec!r} with {self.bits} bits, which is not decoded")
        stride = (self.width * self.bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(raw, np.uint8, stride * self.height).reshape(self.height, stride)
        rows = rows[::-1] if self.upside_down else rows
        if self.bits == 8:
            index = rows[:, : self.width]
            return self.palette[index] if self.palette is not None else np.repeat(index[:, :, None], 3, 2)
        return rows[:, : self.width * self.bits // 8].reshape(self.height, self.width, -1)[:, :, 2::-1]

    def waveform(self, start: float, end: float | None) -> np.ndarray:
        """Channels x samples from `start` to before `end` seconds; one channel without samples where there are none."""
        step = self.sample_bytes * self.channels
        total = sum(size for _, size in self.sound) // step if step else 0
        first = min(total, max(0, int(start * self.rate)))
        last = total if end is None else min(total, max(first, int(end * self.rate)))
        if first >= last:
            return np.zeros((1, 0), np.float32)
        parts, at, lo, hi = [], 0, first * step, last * step
        for offset, size in self.sound:
            a, b = max(lo, at), min(hi, at + size)
            if a < b:
                parts.append(self.data[offset + a - at : offset + b - at])
            at += size
        raw = b"".join(parts)
        values = np.frombuffer(raw, f"<f{self.sample_bytes}").astype(np.float32) if self.floats else pcm_samples(raw, self.sample_bytes)
        return values.reshape(-1, self.channels).T


def _from_yuv(raw: np.ndarray, width: int, height: int) -> np.ndarray:
    """RGB of planar YUV with halved chroma, by the fixed values of standard definition video (16 to 235)."""
    half_w, half_h = (width + 1) // 2, (height + 1) // 2
    n, m = width * height, half_w * half_h
    y = (raw[:n].reshape(height, width).astype(np.float64) - 16) * 255 / 219
    u, v = (np.repeat(np.repeat(raw[n + i * m : n + (i + 1) * m].reshape(half_h, half_w), 2, 0), 2, 1)[:height, :width].astype(np.float64) - 128 for i in (0, 1))
    u, v = u * 255 / 224, v * 255 / 224
    rgb = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks in a part of a file; lists are opened, a cut last chunk is left out."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if name in (b"RIFF", b"LIST"):
            yield name + bytes(data[at : at + 4]), at + 4, size - 4
            yield from _chunks(data, at + 4, min(end, at + size))
        elif at + size <= end:
            yield name, at, size
        at += size + size % 2


def open_video(content: bytes) -> Video:
    """The first video and the first sound stream of an AVI file; no frame is decoded."""
    data = memoryview(content)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    out, kind, stream, video, sound = Video(data), b"", -1, None, None
    for name, at, size in _chunks(data, 0, len(data)):
        if name == b"strh":
            stream += 1
            kind = bytes(data[at : at + 4])
            if kind == b"vids" and video is None:
                video = stream
                scale, rate = struct.unpack_from("<II", data, at + 20)
                out.fps = rate / scale
            elif kind == b"auds" and sound is None:
                sound = stream
        elif name == b"strf" and kind == b"vids" and stream == video:
            head, out.width, height, _, out.bits, out.codec = struct.unpack_from("<IiiHH4s", data, at)
            out.height, out.upside_down = abs(height), height > 0
            if out.bits == 8 and size > head:
                colours = np.frombuffer(data[at + head : at + size], np.uint8)
                table = np.zeros((256, 4), np.uint8)
                table[: len(colours) // 4] = colours[: len(colours) // 4 * 4].reshape(-1, 4)
                out.palette = table[:, 2::-1]
        elif name == b"strf" and kind == b"auds" and stream == sound:
            form, out.channels, out.rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if form == 0xFFFE:  # extensible: the format is in its first bytes of the sub format
                form = struct.unpack_from("<H", data, at + 24)[0]
            if form not in (1, 3):
                out.channels = 0  # sound that is not PCM counts as none
            out.sample_bytes, out.floats = bits // 8, form == 3
        elif name[:2].isdigit() and name[2:] in (b"db", b"dc") and int(name[:2]) == video:
            out.frames.append((at, size))
        elif name[:2].isdigit() and name[2:] == b"wb" and int(name[:2]) == sound:
            out.sound.append((at, size))
    if video is None or not out.frames:
        raise ValueError("no frames")
    return out


def frames_near(times: Sequence[float], n: int, fps: float, approximate: bool = False) -> list[int]:
    """The number of the frame shown nearest to every time, which must not fall. Exact seeking allows half a frame and a millisecond, approximate seeking a fixed buffer."""
    reach = BUFFER_S if approximate else exact_tolerance(fps)
    if any(b < a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("times must not fall")
    out = []
    for t in times:
        i = min(n - 1, max(0, int(np.ceil(t * fps - 0.5))))  # the earlier of two equally near frames
        if abs(i / fps - t) > reach:
            raise ValueError(f"no frame near {t} s")
        out.append(i)
    return out


def _or_null(x: Column, of: str) -> Column:
    """A struct whose first field is null as null. Spark runs the function once."""
    return F.when(x[of].isNotNull(), x)


def video_info(content: Column, strict: bool = True) -> Column:
    """Struct fps, frames, width, height, duration, rate, channels (0 where there is no sound)."""

    def one(data: bytes) -> tuple:
        v = open_video(data)
        return v.fps, len(v.frames), v.width, v.height, len(v.frames) / v.fps, v.rate if v.channels else 0, v.channels

    run = _each(one, ("fps", "frames", "width", "height", "duration", "rate", "channels"), strict)

    @batched_udf(INFO)
    def info(contents: pd.Series) -> pd.DataFrame:
        return run(contents)

    return _or_null(info(content), "fps")


def clip_plan(
    duration: Column,
    fps: Column,
    frames: int,
    framerate: Column | float | None = None,
    speedup: Column | float | None = None,
    allow_shorter: bool = False,
    crop: Column | None = None,
    soft: bool = False,
    key: Column | None = None,
    seed: int = 42,
) -> Column:
    """Struct start, clip (seconds), times: where the frames of a clip are, or null if the video cannot give it.

    `framerate` replaces the file's own for the spacing, `speedup` divides it. `crop` is a struct
    (start, end): used as it is, or widened to the clip's length where `soft`. With a key the start
    is drawn within the interval, fixed by key and seed; else it is the interval's.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    rate = fps if framerate is None else as_column(framerate)
    rate = rate if speedup is None else rate / as_column(speedup)
    count = frame_count(duration, rate, frames)
    clip = count / rate
    whole = F.struct(F.lit(0.0).alias("start"), duration.alias("end"))
    span = whole if crop is None else F.when(crop.isNull(), whole).otherwise(soft_crop(crop["start"], crop["end"], clip, duration) if soft else F.struct(crop["start"].cast("double").alias("start"), crop["end"].cast("double").alias("end")))
    room = F.greatest(span["end"] - span["start"] - clip, F.lit(0.0))
    start = span["start"] + (F.lit(0.0) if key is None else hash_uniform(F.lit(str(seed)), key) * room)
    ok = F.lit(True) if crop is None or soft else crop.isNull() | hard_crop_ok(crop["start"], crop["end"], clip, duration)
    if not allow_shorter:
        ok = ok & (F.lit(frames) / rate <= duration)
    return F.when(ok, F.struct(start.alias("start"), clip.alias("clip"), frame_times(start, rate, count, duration).alias("times")))


def _pairs(decode: Callable[..., tuple], names: tuple[str, ...], strict: bool) -> Callable[..., pd.DataFrame]:
    def run(contents: pd.Series, *given: pd.Series) -> pd.DataFrame:
        rows = []
        for content, *values in zip(contents, *given, strict=True):
            try:
                rows.append((None,) * len(names) if content is None or values[0] is None else decode(bytes(content), *values))
            except Exception:
                if strict:
                    raise
                rows.append((None,) * len(names))
        return pd.DataFrame(rows, columns=list(names), dtype=object)

    return run


def decode_frames(content: Column, times: Column, approximate: bool = False, real_fps: Column | None = None, strict: bool = True) -> Column:
    """Struct frames, channels, height, width, pixels (frame by frame, each plane by plane) and numbers of the frames at the times of an array. `real_fps` replaces the file's own rate."""

    def one(data: bytes, times: np.ndarray, fps: float | None) -> tuple:
        v = open_video(data)
        found = frames_near([float(t) for t in times], len(v.frames), v.fps if fps is None or fps != fps else fps, approximate)
        planes = {i: v.pixels(i).transpose(2, 0, 1) for i in set(found)}
        height, width = planes[found[0]].shape[1:] if found else (v.height, v.width)
        return len(found), 3, height, width, b"".join(planes[i].tobytes() for i in found), found

    run = _pairs(one, ("frames", "channels", "height", "width", "pixels", "numbers"), strict)

    @batched_udf(CLIP)
    def frames(contents: pd.Series, at: pd.Series, fps: pd.Series) -> pd.DataFrame:
        return run(contents, at, fps)

    return _or_null(frames(content, times, F.lit(None).cast("double") if real_fps is None else real_fps.cast("double")), "frames")


def decode_sound(content: Column, start: Column, end: Column | None = None, strict: bool = True) -> Column:
    """Struct rate, channels of a video file's sound from `start` to before `end` seconds (null: its end), to the sample; one channel without samples where there is none."""

    def one(data: bytes, start: float, end: float | None) -> tuple:
        v = open_video(data)
        return v.rate, list(v.waveform(start, None if end is None or end != end else end))

    run = _pairs(one, ("rate", "channels"), strict)

    @batched_udf(AUDIO)
    def sound(contents: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return run(contents, starts.astype(object).where(starts.notna(), None), ends)

    return _or_null(sound(content, start.cast("double"), F.lit(None).cast("double") if end is None else end.cast("double")), "rate")


def with_clip(
    df: DataFrame,
    content: str,
    frames: int,
    video: str = "video",
    audio: str | None = None,
    times: str = "frame_times",
    duration: str = "clip_duration",
    real_duration: Column | None = None,
    real_fps: Column | None = None,
    given_times: Column | None = None,
    silent_below: float | None = None,
    approximate: bool = False,
    strict: bool = True,
    **plan: Any,
) -> DataFrame:
    """Adds the frames of one clip per row, their times, the clip's length and, if asked for, its sound; further arguments are those of `clip_plan`.

    Duration and rate that an index already holds (`real_duration`, `real_fps`) save the pass over
    the contents that reads them from the files. `given_times` replaces the planned ones. Rows whose
    sound never reaches `silent_below` go. Strict: a video that cannot give the clip is an error.
    """
    if silent_below is not None and audio is None:
        raise ValueError("silence needs the sound")
    if real_duration is None or real_fps is None:
        df = df.withColumn("_info", video_info(F.col(content), strict))
        fps = F.col("_info.fps") if real_fps is None else real_fps
        long = F.col("_info.frames") / fps if real_duration is None else real_duration
    else:
        fps, long = real_fps, real_duration
    planned = clip_plan(long.cast("double"), fps.cast("double"), frames, **plan)
    if strict:
        refused = F.raise_error("a video is too short for the clip, or its interval").cast("struct<start:double,clip:double,times:array<double>>")
        planned = F.when(F.col(content).isNull(), F.lit(None)).otherwise(F.coalesce(planned, refused))
    df = df.withColumn("_plan", planned)
    df = df.withColumn(times, F.col("_plan.times") if given_times is None else given_times).withColumn(duration, F.col("_plan.clip"))
    start = F.col(times)[0]
    df = df.withColumn("_frames", decode_frames(F.col(content), F.col(times), approximate, real_fps, strict))
    if audio is not None:
        df = df.withColumn(audio, decode_sound(F.col(content), start, start + F.col(duration), strict))
    df = df.withColumn(video, F.col("_frames")).drop("_frames", "_plan", "_info")
    if silent_below is None:
        return df
    return without_silence(df.withColumn("_sound", F.col(f"{audio}.channels")), "_sound", silent_below).drop("_sound")
