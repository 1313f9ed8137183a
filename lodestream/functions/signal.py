"""Audio filters inside Arrow batches: band-limited resampling, recursive filters and gated loudness."""

from __future__ import annotations

from math import ceil, gcd, pi, tan

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import batched_udf
CHANNELS = "array<array<float>>"
#: Fixed values of the loudness standard (ITU-R BS.1770): shelf and high-pass (frequency, quality), the shelf's gain in dB and the exponent of its band gain, block and step in seconds, gates in LUFS and LU, offset, channel weights.
SHELF, HIGH_PASS, SHELF_GAIN, BAND_POWER = (1681.974450955533, 0.7071752369554196), (38.13547087602444, 0.5003270373238773), 3.999843853973347, 0.4996667741545416
BLOCK_S, STEP_S, ABSOLUTE, RELATIVE, OFFSET, WEIGHTS = 0.4, 0.1, -70.0, -10.0, -0.691, (1.0, 1.0, 1.0, 1.41, 1.41)
#: Rows of windows that are multiplied with the filter bank at once.
_ROWS = 1 << 14


def filter_bank(rate: int, target: int, zeros: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int]:
    """(phases x taps, samples before): a windowed sinc for each of the target's phases, cut off below half the lower rate."""
    cut = min(rate, target) * rolloff
    before = ceil(zeros * rate / cut)
    time = np.arange(-before, before + rate)[None, :] / rate - np.arange(target)[:, None] / target
    x = np.clip(time * cut, -zeros, zeros)
    return np.sinc(x) * np.cos(x * pi / zeros / 2) ** 2 * cut / rate, before


def resampled(channel: np.ndarray, rate: int, target: int, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """n samples become ceil(n * target / rate): every phase of the filter bank slides over the signal."""
    if rate == target or not len(channel):
        return np.asarray(channel, np.float32)
    common = gcd(rate, target)
    rate, target = rate // common, target // common
    bank, before = filter_bank(rate, target, zeros, rolloff)
    n = -(-len(channel) * target // rate)
    windows = sliding_window_view(np.pad(np.asarray(channel, float), (before, before + rate)), bank.shape[1])[::rate]
    parts = [windows[a : a + _ROWS] @ bank.T for a in range(0, len(windows), _ROWS)]
    return np.concatenate(parts).reshape(-1)[:n].astype(np.float32)


def recursive(x: np.ndarray, b: np.ndarray, a: np.ndarray, block: int = 128) -> np.ndarray:
    """A second-order recursive filter, exactly: blocks are filtered at once as if each began at rest, then the two states pass from block to block."""
    n = -(-len(x) // block) * block
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    inlet = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    out = np.array([p[0] for p in powers[:block]])  # what a state at the block's start adds to each sample
    impulse = np.r_[b[0], [p[0] @ inlet for p in powers[: block - 1]]]
    shifted = np.arange(block)[:, None] - np.arange(block)[None, :]
    within = np.where(shifted >= 0, impulse[shifted], 0.0)
    gathered = np.array([powers[block - 1 - i] @ inlet for i in range(block)])
    blocks = np.pad(x, (0, n - len(x))).reshape(-1, block)
    added = blocks @ gathered
    states, state = np.empty((len(blocks), 2)), np.zeros(2)
    for k in range(len(blocks)):
        states[k] = state
        state = powers[block] @ state + added[k]
    return (blocks @ within.T + states @ out.T).reshape(-1)[: len(x)]


def k_weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """The standard's two filters in a row: a shelf for the head, then a high-pass."""

    def poles(f: float, q: float) -> tuple[float, float, np.ndarray]:
        k = tan(pi * f / rate)
        whole = 1 + k / q + k * k
        return k, whole, np.array([1.0, 2 * (k * k - 1) / whole, (1 - k / q + k * k) / whole])

    k, whole, a = poles(*SHELF)
    high, q = 10 ** (SHELF_GAIN / 20), SHELF[1]
    band = high**BAND_POWER
    b = np.array([high + band * k / q + k * k, 2 * (k * k - high), high - band * k / q + k * k]) / whole
    _, _, a2 = poles(*HIGH_PASS)
    return recursive(recursive(x, b, a), np.array([1.0, -2.0, 1.0]), a2)


def loudness_of(channels: list[np.ndarray], rate: int) -> float:
    """Integrated loudness in LUFS, gated twice; -70 where nothing passes the gate. Less than one block is padded with silence."""
    block, step = int(rate * BLOCK_S), int(rate * STEP_S)
    power = None
    for x, weight in zip(channels, WEIGHTS, strict=False):
        y = np.cumsum(np.r_[0.0, k_weighted(np.pad(np.asarray(x, float), (0, max(0, block - len(x)))), rate) ** 2])
        own = weight * (y[block::step] - y[: len(y) - block : step]) / block
        power = own if power is None else power + own
    level = lambda p: OFFSET + 10 * np.log10(np.maximum(p, 1e-20))
    if power is None or not (loud := power[level(power) > ABSOLUTE]).size:
        return ABSOLUTE
    kept = loud[level(loud) > level(loud.mean()) + RELATIVE]
    return float(level(kept.mean()))


def resample(channels: Column, rate: Column, target: int, zeros: int = 6, rolloff: float = 0.99) -> Column:
    """Band-limited resampling of every channel: what lies above half the lower rate is removed, not folded back."""

    @batched_udf(CHANNELS)
    def run(many: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or r is None or r != r else [resampled(x, int(r), target, zeros, rolloff) for x in c] for c, r in zip(many, rates, strict=True)], dtype=object)

    return run(channels, rate)


def loudness(channels: Column, rate: Column) -> Column:
    @batched_udf("double")
    def run(many: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or r is None or r != r else loudness_of(list(c), int(r)) for c, r in zip(many, rates, strict=True)], dtype=float)

    return run(channels, rate)


def normalize_loudness(channels: Column, rate: Column, db: float = -24.0) -> Column:
    """Scales all channels so that no sample exceeds 1, then to a loudness of `db` LUFS. Silence stays."""

    @batched_udf(CHANNELS)
    def run(many: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(many, rates, strict=True):
            if c is None or r is None or r != r:
                out.append(None)
                continue
            c = [np.asarray(x, float) for x in c]
            peak = max((np.abs(x).max() for x in c if len(x)), default=0.0)
            c = [x / max(1.0, peak) for x in c]
            gain = 10 ** ((db - loudness_of(c, int(r))) / 20)
            out.append([(x * gain).astype(np.float32) for x in c])
        return pd.Series(out, dtype=object)

    return run(channels, rate)


def resize(channels: Column, rate: Column, target: int, seconds: Column | None = None, length: int | None = None) -> Column:
    """Resampled, then trimmed or padded with zeros on the right: to `length` samples, or those of a duration, the audio's own if none is given."""
    from .media import pad_or_trim

    own = F.size(channels[0]) / rate
    wanted = F.lit(length) if length is not None else F.floor(F.lit(target) * (own if seconds is None else seconds)).cast("int")
    return F.transform(resample(channels, rate, target), lambda c: pad_or_trim(c, wanted))


def without_silence(df: DataFrame, channels: str, threshold: float, on_silence: str = "drop") -> DataFrame:
    """Samples whose largest amplitude over all channels reaches the threshold; others go, or are an error. Samples without audio go too."""
    peak = F.coalesce(F.array_max(F.transform(F.flatten(channels), F.abs)), F.lit(0.0)).cast("double")
    if on_silence == "drop":
        return df.where(peak >= threshold)
    if on_silence != "fail":
        raise ValueError(f"unknown on_silence {on_silence!r}")
    return df.where(F.when(peak >= threshold, F.lit(True)).otherwise(F.raise_error(F.lit("silent audio")).cast("boolean")))
