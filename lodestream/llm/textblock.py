"""Vectorised byte and word arithmetic over batches of UTF-8 texts.

Texts of an Arrow batch lie one after the other in one buffer, so words, lines and windows of
every text are found with a few numpy passes and no Python string is made. A word is a maximal run
of bytes other than space and 0x09 to 0x0D; since these are ASCII, byte runs are character runs.

Fingerprints have 64 bits. That of a string of bytes is the sum, modulo 2**64, of one random number
for each pair of a place in the string and the byte there; that of a window of values doubles
windows up: the fingerprint of a longer window mixes those of its two halves. Neither has an
algebraic structure by which regular strings could agree, so two different strings agree with a
probability near 2**-64. Operators that must not rest on that compare the strings themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 18
NEAR = 64  # places of a string whose random numbers are tabulated

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all of them (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The random number of each place in a string and the byte there."""
    x = place.astype(U64)
    x <<= U64(8)
    x += byte
    x += U64(1)
    x *= U64(0x9E3779B97F4A7C15)
    return mix(x)


_TABLE = _numbers(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256, dtype=np.uint8), NEAR))


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end] for arrays of starts and ends in rising order that do not overlap."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    cut = np.cumsum(size)
    total = int(cut[-1])
    place = np.arange(total)
    place -= np.repeat(cut - size, size)
    byte = data[start[0] : end[-1]] if total == end[-1] - start[0] else data[place + np.repeat(start, size)]
    near = place < NEAR
    if near.all():
        place <<= 8
        place += byte
        values = _TABLE[place]
    else:
        values = np.empty(total, U64)
        values[near] = _TABLE[(place[near] << 8) + byte[near]]
        values[~near] = _numbers(place[~near], byte[~near])
    sums = np.zeros(total + 1, U64)
    np.cumsum(values, out=sums[1:])
    out = sums[cut] - sums[cut - size]
    out += size.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of values[i : i + width] for every i, by doubling."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        right = out[step:] * U64(0xD6E8FEB86659FD93)
        right += out[: len(out) - step]
        right ^= right >> U64(32)
        right *= U64(0x9E3779B97F4A7C15)
        right ^= right >> U64(29)
        out, have = right, have + step
    return out[: max(0, len(values) - width + 1)]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row, bytes, offsets) with about `limit` bytes each; a longer text comes alone and whole. Null counts as empty."""
    limit = limit or PIECE
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each position."""
    return np.searchsorted(off, at, "right") - 1


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a piece: start, end, owning text `doc`, and `at`, the words before each text (with the total at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data, self.off = data, off
        self.start, self.end = runs(~SPACE[data], off)
        self.doc = owner(off, self.start)
        self.at = np.searchsorted(self.start, off)
        self._lower = lower

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        return strings(LOWER[self.data] if self._lower else self.data, self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and fingerprints of the k-word windows inside one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, windows(hashes, k)[at]


def within(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each [start, end)."""
    return np.searchsorted(places, end) - np.searchsorted(places, start)


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    d = np.bincount(start, minlength=n + 1)
    d -= np.bincount(start + length, minlength=n + 1)
    return np.cumsum(d[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `of`. A table of low bits settles most that are not."""
    return found(keys, of) >= 0


def found(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted array `of`, or -1."""
    out = np.full(len(keys), -1)
    if not len(of) or not len(keys):
        return out
    bits = U64((1 << max(10, min(26, (16 * len(of)).bit_length()))) - 1)
    low = np.zeros(int(bits) + 1, bool)
    low[of & bits] = True
    maybe = np.flatnonzero(low[keys & bits])
    at = np.searchsorted(of, keys[maybe])
    at[at == len(of)] = 0
    ok = of[at] == keys[maybe]
    out[maybe[ok]] = at[ok]
    return out
