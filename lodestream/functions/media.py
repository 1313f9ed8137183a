"""Arithmetic of images, clips, audio and latents, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def center_crop(width: Column, height: Column, aspect: Column | float) -> Column:
    """Struct left, top, right, bottom of the largest centred crop with this aspect ratio (width by height)."""
    aspect = aspect if isinstance(aspect, Column) else F.lit(float(aspect))
    wide = width / height > aspect
    w = F.when(wide, F.floor(height * aspect)).otherwise(width).cast("long")
    h = F.when(wide, height).otherwise(F.floor(width / aspect)).cast("long")
    left, top = F.floor((width - w) / 2).cast("long"), F.floor((height - h) / 2).cast("long")
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))


def target_resolution(width: Column, height: Column, h: int, w: int, allow_vertical: bool = False) -> Column:
    """Struct h, w to resize to; a vertical source swaps them if allowed."""
    vertical = (height > width) & F.lit(allow_vertical)
    return F.struct(F.when(vertical, F.lit(max(h, w))).otherwise(F.lit(h)).alias("h"), F.when(vertical, F.lit(min(h, w))).otherwise(F.lit(w)).alias("w"))


def is_distorted(width: Column, height: Column, aspect: Column, tolerance: float = 0.02) -> Column:
    """Whether the stored shape differs from the true aspect ratio by more than the tolerance."""
    return F.abs(width / height - aspect) > tolerance


def normalize_bytes(values: Column) -> Column:
    """Bytes 0 to 255 as floats from -1 to 1."""
    return F.transform(values, lambda x: (x / F.lit(127.5) - 1).cast("float"))


def frame_count(duration: Column, fps: Column, wanted: int) -> Column:
    """Frames to take: fewer, but at least one, where the clip is longer than the video."""
    return F.when(F.lit(wanted) / fps > duration, F.greatest(F.lit(1), F.floor(duration * fps).cast("int"))).otherwise(F.lit(wanted))


def frame_times(start: Column, fps: Column, count: Column, duration: Column) -> Column:
    """Evenly spaced times of `count` frames from `start` on, none after the end."""
    last = F.greatest(count / fps - 1 / fps, F.lit(0.0))
    step = F.when(count > 1, last / (count - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(start + i * step, duration))


def soft_crop(start: Column, end: Column, clip: Column, duration: Column) -> Column:
    """Struct start, end: the interval, widened on both sides to the clip's length and moved into [0, duration]."""
    a, b = F.greatest(start, F.lit(0.0)), F.least(end, duration)
    pad = F.greatest((clip - (b - a)) / 2, F.lit(0.0))
    a, b = a - pad, b + pad
    over = F.greatest(b - duration, F.lit(0.0))
    a, b = a - over, b - over
    under = F.greatest(-a, F.lit(0.0))
    a, b = a + under, b + under
    return F.struct(F.greatest(a, F.lit(0.0)).alias("start"), F.least(b, duration).alias("end"))


def hard_crop_ok(start: Column, end: Column, clip: Column, duration: Column) -> Column:
    """Whether an interval can be used as it is."""
    return (end - start >= clip) & (start >= 0) & (end <= duration)


def pad_or_trim(values: Column, n: int | Column, fill: Column | float = 0.0) -> Column:
    """Exactly n elements: trimmed, or padded on the right."""
    fill = fill if isinstance(fill, Column) else F.lit(float(fill)).cast("float")
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(fill, F.greatest(n - F.size(values), F.lit(0))))


def pad_tokens(tokens: Column, end: Column, n: int, width: int) -> Column:
    """Token vectors up to the end token, zero vectors after it, n in all."""
    zero = F.array_repeat(F.lit(0.0), width)
    kept = F.transform(F.slice(tokens, 1, n), lambda v, i: F.when(i <= end, v).otherwise(zero))
    return F.concat(kept, F.array_repeat(zero, F.greatest(F.lit(n) - F.size(tokens), F.lit(0))))


@F.pandas_udf(T.IntegerType())
def _loudest(samples: pd.Series, windows: pd.Series) -> pd.Series:
    def one(values: np.ndarray | None, window: int) -> int | None:
        if values is not None and len(values) and isinstance(values[0], np.ndarray):
            values = np.abs(np.stack(values)).mean(axis=0)
        if values is None or len(values) < window or window < 1:
            return None
        sums = np.concatenate([[0.0], np.cumsum(np.abs(np.asarray(values, float)))])
        return int(np.argmax(sums[window:] - sums[:-window]))

    return pd.Series([one(v, w) for v, w in zip(samples, windows, strict=True)], dtype="Int32")


def loudest_window(samples: Column, window: int | Column) -> Column:
    """0-based start of the window with the largest mean absolute value, of one channel or of an array of them; the first of equal ones. Every start counts, 0 too. Prefix sums, which built-in array functions cannot do in linear time."""
    return _loudest(samples, (window if isinstance(window, Column) else F.lit(window)).cast("int"))


def is_silent(samples: Column, threshold: float) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0)) < threshold


def mono(channels: Column) -> Column:
    """Mean over channels of equally long sample arrays."""
    n = F.size(channels)
    return F.transform(channels[0], lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + c[i]) / n)


def sample_latent(mean: Column, logvar: Column, noise: Column) -> Column:
    """mean + noise * exp(logvar / 2), element by element."""
    spread = F.zip_with(logvar, noise, lambda v, e: e * F.exp(v / 2))
    return F.zip_with(mean, spread, lambda m, s: m + s)


def hash_normal(*parts: Column) -> Column:
    """A standard normal number that depends on the parts alone (Box-Muller)."""
    from .values import hash_uniform

    u, v = hash_uniform(*parts, "u"), hash_uniform(*parts, "v")
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def strided_frames(total: int, wanted: int, rgb_frames: int, skip: int = 1, start: int = 0) -> list[int]:
    """Latent frames that hold `wanted` of `rgb_frames` frames, taking every `skip`-th."""
    rate = -(-rgb_frames // total)
    n = -(-wanted // rate)
    if n * skip > total:
        raise ValueError(f"{n} latent frames with stride {skip} do not fit {total}")
    return list(range(start, start + n, skip))
