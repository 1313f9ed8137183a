"""Cropping and resampling of decoded images inside Arrow batches, one axis after the other."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import batched_udf
from .decode import IMAGE
from .values import hash_uniform, weighted_pick


def _area(x: np.ndarray) -> np.ndarray:
    return ((x > -0.5) & (x <= 0.5)).astype(float)


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _bicubic(x: np.ndarray) -> np.ndarray:
    """The cubic with slope -0.5."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernel and its half-width in pixels of the coarser grid.
KERNELS = {"area": (_area, 0.5), "bilinear": (_bilinear, 1.0), "bicubic": (_bicubic, 2.0), "lanczos": (_lanczos, 3.0)}


#: Bits of the weights' fractions: arithmetic in whole numbers gives the same bytes on every machine.
BITS = 22


def weights(size: int, target: int, kernel: str) -> np.ndarray:
    """target x size: each new pixel as a weighted mean of the old ones around it. Shrinking widens the kernel, so that nothing aliases."""
    shape, half = KERNELS[kernel]
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    first, last = np.maximum(0, (centre - half * wide + 0.5).astype(int)), np.minimum(size, (centre + half * wide + 0.5).astype(int))
    at = np.arange(size)[None, :]
    w = np.where((at >= first[:, None]) & (at < last[:, None]), shape((at + 0.5 - centre[:, None]) / wide), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, height: int, width: int, kernel: str = "bilinear") -> np.ndarray:
    """Bytes of height x width x channels: rows first, rounded to bytes, then columns. "nearest" takes the pixel at the new one's centre."""
    if kernel == "nearest":
        pick = lambda size, target: np.minimum(size - 1, ((np.arange(target) + 0.5) * size / target).astype(int))
        return pixels[pick(pixels.shape[0], height)][:, pick(pixels.shape[1], width)]
    fixed = lambda w: np.trunc(w * (1 << BITS) + np.copysign(0.5, w))  # noqa: E731  whole numbers, which sums of doubles keep exactly
    as_bytes = lambda x: np.clip((x.astype(np.int64) + (1 << BITS - 1)) >> BITS, 0, 255).astype(np.uint8)
    if pixels.shape[1] != width:
        pixels = as_bytes(np.einsum("tw,hwc->htc", fixed(weights(pixels.shape[1], width, kernel)), pixels.astype(float)))
    if pixels.shape[0] != height:
        pixels = as_bytes(np.einsum("th,hwc->twc", fixed(weights(pixels.shape[0], height, kernel)), pixels.astype(float)))
    return pixels


def crop_resize(image: Column, box: Column, height: Column | int, width: Column | int, kernel: str = "bilinear", planar: bool = False) -> Column:
    """An image (struct height, width, pixels) cut to a box (struct left, top, right, bottom) and resized. Pixels are planes where `planar`, else rows of RGB."""
    if kernel != "nearest" and kernel not in KERNELS:
        raise ValueError(f"kernel must be nearest or one of {sorted(KERNELS)}")

    @batched_udf(IMAGE)
    def run(images: pd.DataFrame, boxes: pd.DataFrame, heights: pd.Series, widths: pd.Series) -> pd.DataFrame:
        rows = []
        for h, w, raw, left, top, right, bottom, new_h, new_w in zip(images["height"], images["width"], images["pixels"], boxes["left"], boxes["top"], boxes["right"], boxes["bottom"], heights, widths, strict=True):
            if raw is None:
                rows.append((None, None, None))
                continue
            h, w = int(h), int(w)
            pixels = np.frombuffer(raw, np.uint8)
            pixels = pixels.reshape(-1, h, w).transpose(1, 2, 0) if planar else pixels.reshape(h, w, -1)
            pixels = resized(pixels[int(top) : int(bottom), int(left) : int(right)], int(new_h), int(new_w), kernel)
            rows.append((int(new_h), int(new_w), (pixels.transpose(2, 0, 1) if planar else pixels).tobytes()))
        return pd.DataFrame(rows, columns=["height", "width", "pixels"], dtype=object)

    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return run(image, box, as_column(height).cast("int"), as_column(width).cast("int"))


def fit(image: Column, height: int, width: int, crop: bool = True, allow_vertical: bool = False, choices: Mapping[tuple[int, int], float] | None = None, key: Column | None = None, seed: int = 42, kernel: str = "bilinear", planar: bool = False) -> Column:
    """An image at height x width: cut to that aspect ratio first unless `crop` is off, swapped for vertical sources if allowed.

    `choices` are resolutions (height, width) with probabilities; one of those that are not larger
    than the source is drawn by key and seed, if there is any.
    """
    from .media import center_crop

    h, w = image["height"], image["width"]
    wanted = F.struct(F.lit(height).alias("h"), F.lit(width).alias("w"))
    if choices:
        if key is None or abs(sum(choices.values()) - 1) > 1e-9:
            raise ValueError("choices need a key and probabilities that sum to 1")
        fits = [F.when((F.lit(a) <= h) & (F.lit(b) <= w), F.lit(float(p))).otherwise(F.lit(0.0)) for (a, b), p in choices.items()]
        listed = F.array(*(F.struct(F.lit(a).alias("h"), F.lit(b).alias("w")) for a, b in choices))
        wanted = F.when(sum(fits, F.lit(0.0)) > 0, F.get(listed, weighted_pick(hash_uniform(F.lit(str(seed)), key), fits))).otherwise(wanted)
    swap = (h > w) & F.lit(allow_vertical)
    new_h = F.when(swap, F.greatest(wanted["h"], wanted["w"])).otherwise(wanted["h"])
    new_w = F.when(swap, F.least(wanted["h"], wanted["w"])).otherwise(wanted["w"])
    whole = F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("top"), w.cast("long").alias("right"), h.cast("long").alias("bottom"))
    box = center_crop(w, h, new_w / new_h) if crop else whole
    return F.when((h == new_h) & (w == new_w), image).otherwise(crop_resize(image, box, new_h, new_w, kernel, planar))
