"""Encoded images and audio to arrays, inside Arrow batches.

PNG and WAV need numpy and the standard library alone; other image formats are read if Pillow can be
imported on the workers. A content that cannot be decoded gives null, an error only where `strict`.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import batched_udf
IMAGE = "height int, width int, pixels binary"
AUDIO = "rate int, channels array<array<float>>"
#: Fixed values of the PNG format: samples per pixel of each colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filter of each scan line (its first byte)."""
    height, stride = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row above and a pixel to the left, all zero
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        here, above = out[y + 1], out[y]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            here[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            here[step:] = line + above[step:]
        else:
            for x in range(step, stride + step, step):
                a, b, c = (v.astype(np.int16) for v in (here[x - step : x], above[x : x + step], above[x - step : x]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                here[x : x + step] = line[x - step : x] + guess.astype(np.uint8)
    return out[1:, step:]


def png_rgb(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG with 8 bits a sample, not interlaced; alpha is dropped, grey is spread."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, header = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if header is None or header[2] != 8 or header[6]:
        raise ValueError("only 8 bits a sample without interlacing")
    width, height, _, colour = header[:4]
    step = _SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * step + 1)
    pixels = _unfilter(rows, step).reshape(height, width, step)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (0, 4) else pixels[:, :, :3]


def image_pixels(data: bytes) -> np.ndarray:
    if data[:4] == b"\x89PNG":
        try:
            return png_rgb(data)
        except (KeyError, ValueError):
            pass  # other depths and interlaced files are left to Pillow
    from PIL import Image

    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))


def pcm_samples(raw: bytes, width: int) -> np.ndarray:
    """PCM samples of 1 (unsigned), 2, 3 or 4 bytes as floats from -1 to 1."""
    data = np.frombuffer(raw, np.uint8).reshape(-1, width)
    if width == 1:
        return data[:, 0].astype(np.float32) / 128 - 1
    wide = np.zeros((len(data), 4), np.uint8)
    wide[:, 4 - width :] = data
    return (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)


def wav_channels(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and channels x samples from -1 to 1 of a PCM file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        values = pcm_samples(w.readframes(w.getnframes()), width)
    return rate, values.reshape(-1, channels).T


def _each(decode: Callable[[bytes], tuple], names: tuple[str, ...], strict: bool) -> Callable[[pd.Series], pd.DataFrame]:
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                rows.append((None,) * len(names) if content is None else decode(bytes(content)))
            except Exception:
                if strict:
                    raise
                rows.append((None,) * len(names))
        return pd.DataFrame(rows, columns=list(names), dtype=object)

    return run


def decode_image(content: Column, planar: bool = False, strict: bool = True) -> Column:
    """Struct height, width, pixels: RGB bytes row by row, or plane by plane (channels first)."""

    def one(data: bytes) -> tuple:
        pixels = image_pixels(data)
        return (*pixels.shape[:2], (pixels.transpose(2, 0, 1) if planar else pixels).tobytes())

    run = _each(one, ("height", "width", "pixels"), strict)

    @batched_udf(IMAGE)
    def decoded(contents: pd.Series) -> pd.DataFrame:
        return run(contents)

    return decoded(content)


def image_as_video(image: Column) -> Column:
    """A planar image as a clip of one frame: struct frames, channels, height, width, pixels."""
    return F.struct(F.lit(1).alias("frames"), F.lit(3).alias("channels"), image["height"].alias("height"), image["width"].alias("width"), image["pixels"].alias("pixels"))


def decode_audio(content: Column, strict: bool = True) -> Column:
    """Struct rate, channels (one array of floats per channel) of WAV contents."""

    def one(data: bytes) -> tuple:
        rate, channels = wav_channels(data)
        return rate, list(channels)

    run = _each(one, ("rate", "channels"), strict)

    @batched_udf(AUDIO)
    def decoded(contents: pd.Series) -> pd.DataFrame:
        return run(contents)

    return decoded(content)


def clip_start(channels: Column, rate: Column, seconds: float, strategy: str = "random", key: Column | None = None, seed: int = 42) -> Column:
    """First sample of a clip: "start", "random" (fixed by key and seed), "max_mean" (loudest window) or "max_center" (around the loudest sample). 0 where the audio is not longer."""
    from .media import loudest_window, mono
    from .values import hash_uniform

    total, wanted = F.size(channels[0]), F.floor(rate * F.lit(float(seconds))).cast("int")
    room = total - wanted
    if strategy == "start":
        start = F.lit(0)
    elif strategy == "random":
        if key is None:
            raise ValueError("a random start needs a key")
        start = F.floor(hash_uniform(F.lit(str(seed)), key) * (room + 1)).cast("int")
    elif strategy == "max_mean":
        start = loudest_window(channels, wanted)
    elif strategy == "max_center":
        loud = mono(F.transform(channels, lambda c: F.transform(c, F.abs)))
        peak = (F.array_position(loud, F.array_max(loud)) - 1).cast("int")
        start = F.greatest(F.lit(0), F.least(peak - F.floor(wanted / 2).cast("int"), room))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.when(room > 0, start).otherwise(0)


def clip(channels: Column, start: Column, n: Column) -> Column:
    return F.transform(channels, lambda c: F.slice(c, start + 1, n))


def resample(channels: Column, rate: Column, target: int) -> Column:
    """Linear interpolation to another sample rate; n samples become ceil(n * target / rate)."""

    def one(c: Column) -> Column:
        n = F.ceil(F.size(c) * F.lit(target) / rate).cast("int")

        def at(i: Column) -> Column:
            x = i * rate / F.lit(target)
            low = F.floor(x).cast("int")
            a, b = F.get(c, low), F.coalesce(F.get(c, low + 1), F.get(c, low))
            return (a + (b - a) * (x - low)).cast("float")

        return F.when(F.size(c) == 0, c).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))

    return F.transform(channels, one)


def normalize_volume(channels: Column, db: float = -24.0) -> Column:
    """Scales all channels so that their mean square is `db` decibels below full scale, then no sample exceeds 1; silence stays."""
    squares = F.aggregate(F.flatten(channels), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    level = F.sqrt(squares / F.size(F.flatten(channels)))
    peak = F.array_max(F.transform(F.flatten(channels), lambda x: F.abs(x).cast("double")))
    gain = F.least(F.lit(10 ** (db / 20)) / level, 1 / peak)
    return F.when(peak > 0, F.transform(channels, lambda c: F.transform(c, lambda x: (x * gain).cast("float")))).otherwise(channels)
