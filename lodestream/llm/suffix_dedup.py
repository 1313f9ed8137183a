"""Difference-cover blockwise duplicate search: removes bytes of long strings that occur elsewhere.

Every `depth`-byte string that starts at two places of the corpus is found, and all bytes that
such strings cover are removed; strings are judged on the input.

The suffixes of a text are sampled at positions whose remainder modulo `PERIOD` is in a difference
cover. For any two positions i and j some shift below PERIOD brings both onto samples, so two equal
strings of `depth` bytes hold a pair of aligned samples that agree for depth - PERIOD + 1 bytes.

1. Cover-sample ranks. Samples are ranked by their first depth - PERIOD + 1 bytes, one bucket at a
   time; each sample with a tied rank is told of a neighbour of the same rank. A sample whose rank
   is unique cannot lie in a repeat and is forgotten, and with it all suffixes that hold only such.
2. Long ties. Tied samples with the same offset form passages. They are fetched from the
   neighbour's text, with PERIOD - 1 bytes to either side, and compared byte by byte with the own
   text: wherever `depth` bytes or more agree, the suffixes are resolved by their samples alone.
3. Short ties. The suffixes within reach of a tied sample that are left are sorted, again one
   bucket at a time, among all suffixes within such reach; those that tie are fetched and compared
   in the same way.

Buckets are ranges of fingerprints of the strings, and ranks need only say what is equal, so no
bucket is in the order of an alphabet; only the comparisons of bytes remove anything. A bucket
holds a bounded number of entries and a block a bounded number of bytes, so memory is bounded by
those two, whatever the corpus. Exact copies of a text are settled by a 128-bit key: all of a text
of `depth` bytes or more is removed when it has a copy.

Null counts as empty; empty and short texts lose nothing. Strings of long texts are found tile by
tile, but a text as a whole must fit some fifteen times into a Python worker's memory. Repeated
rows are copies of each other. An empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WANT, Block, corpus, exchange, fetched, opened, told, wanted
from .tables import bounded, drop_kept, ends_shuffles, keep
from .textblock import PIECE, U64, covered, found, mix, owner, runs, windows

DEPTH, PERIOD = 200, 73
#: Powers of two modulo 73: every nonzero remainder is a difference of two of them.
COVER = sorted({pow(2, k, PERIOD) for k in range(9)})
NOTHING = hashlib.sha256(b"").hexdigest()


def tiles(data: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Yields (first, last, fingerprints of the strings of `reach` bytes that start in [first, last)). Bounds memory for long texts."""
    for a in range(0, len(data), PIECE):
        b = min(len(data), a + PIECE)
        part = data[a : min(len(data), b + reach - 1)]
        if len(part) < reach:
            return
        # values of eight bytes each, then doubled up
        eight = np.ndarray((len(part) - 7,), "<u8", part.tobytes(), 0, (1,)).copy()
        eight *= U64(0x9E3779B97F4A7C15)
        yield a, b, windows(mix(eight), reach - 7)


def fingerprints(data: np.ndarray, off: np.ndarray, length: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the strings of `length` bytes inside a text, at marked places (all without marks)."""
    among = np.ones(len(data), bool) if among is None else among.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        among[max(a, b - length + 1) : b] = False
    starts, fps = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for first, last, every in tiles(data, length):
        at = np.flatnonzero(among[first : first + len(every)])
        starts.append(first + at)
        fps.append(every[at])
    return np.concatenate(starts), np.concatenate(fps)


def samples(data: np.ndarray, off: np.ndarray, rank_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of cover samples and fingerprints of what they are ranked by. A text's samples are counted from its own start."""
    cover = np.zeros(PERIOD, bool)
    cover[COVER] = True
    at = np.arange(len(data))
    at -= np.repeat(off[:-1], np.diff(off))
    at %= PERIOD
    return fingerprints(data, off, rank_depth, cover[at])


def first_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints, one entry of each, and for every entry the entry of the same kind before it (-1 for the first)."""
    order = np.argsort(fps)
    s = fps[order]
    again = np.zeros(len(s) + 1, bool)
    again[1:-1] = s[1:] == s[:-1]
    before = np.full(len(s), -1)
    some = np.sort(order[again[:-1] | again[1:]])  # only these need their order of places
    kinds = fps[some]
    by = np.argsort(kinds, kind="stable")
    same = kinds[by[1:]] == kinds[by[:-1]]
    before[some[by[1:][same]]] = some[by[:-1][same]]
    return s[~again[:-1]], order[~again[:-1]], before


def _emit_samples(depth: int):
    def emit(block: Block) -> Iterator[tuple[np.ndarray, dict]]:
        starts, ranks = samples(block.data, block.off, depth - PERIOD + 1)
        fps, first, _ = first_of(ranks)
        yield fps, {"place": starts[first].astype(np.uint32), "check": np.zeros(len(fps), np.uint32)}

    return emit


def tied(block: Block, starts: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings tie, and block and start of one of the same rank: the one before in this block, else another block's, else the next in this block."""
    at = found(fps, block.found)
    _, _, before = first_of(fps)
    after = np.full(len(fps), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    near = np.where(before >= 0, before, np.where(at >= 0, -1, after))
    has = (near >= 0) | (at >= 0)
    source = np.where(near >= 0, block.number, block.source[at] if len(block.source) else 0)
    place = np.where(near >= 0, starts[near] if len(starts) else 0, block.place[at] if len(block.place) else 0)
    return has, source, place


def listed(block: Block, name: str, *fields: str) -> list[pa.Array]:
    """The fields of a list of structs that this block's row has."""
    rows = block.more[name]
    if not rows.is_valid:
        return [pa.array([], pa.binary() if f == "text" else pa.int64()) for f in fields]
    columns = dict(zip((f.name for f in rows.values.type), rows.values.flatten(), strict=True))
    return [columns[f] for f in fields]


def resolved(block: Block, passages: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes agree with a fetched passage in a stretch of `depth` or more, and which suffixes such a stretch begins."""
    here, left, text = listed(block, passages, "here", "left", "text")
    here, left = here.to_numpy(), left.to_numpy()
    begin, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(here), 1024):
        part = text.slice(k, 1024)
        _, offsets, raw = part.buffers()
        off = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        start, t = here[k : k + 1024] - left[k : k + 1024], owner(block.off, here[k : k + 1024])
        cut = np.maximum(0, block.off[t] - start)
        n = np.maximum(0, np.minimum(np.diff(off), block.off[t + 1] - start) - cut)
        start, bounds = start + cut, np.concatenate([[0], np.cumsum(n)])
        own = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], n)
        same = block.data[own] == np.frombuffer(raw, np.uint8)[own + np.repeat(off[:-1] + cut - start, n)]
        a, b = runs(same, bounds)
        long = b - a >= depth
        a, b = a[long], b[long]
        begin.append(own[a])
        size.append(b - a)
    begin, size = np.concatenate(begin), np.concatenate(size)
    return covered(len(block.data), begin, size), covered(len(block.data), begin, size - depth + 1)


def in_reach(n: int, starts: np.ndarray, back: int) -> np.ndarray:
    """Places at most `back` before one of the starts."""
    return covered(n, np.maximum(starts - back, 0), starts + 1 - np.maximum(starts - back, 0))


def _passage(margin: int):
    def cut(block: Block, place: int, n: int) -> tuple[int, bytes]:
        t = int(owner(block.off, np.array([place]))[0])
        a, b = max(int(block.off[t]), place - margin), min(int(block.off[t + 1]), place + n + margin)
        return place - a, block.data[a:b].tobytes()

    return cut


def longest(asked: pa.RecordBatch, n_bytes: int) -> pa.RecordBatch:
    """The longest passages first, without those that lie within others: of a text that many share, each sample may be told of another neighbour. What is left out here, step 3 settles."""
    here, n = asked.column("here").to_numpy(), asked.column("n").to_numpy()
    seen, take = np.zeros(n_bytes, bool), np.zeros(len(here), bool)
    for i in np.argsort(-n, kind="stable").tolist():
        a, b = here[i], here[i] + n[i]
        if not seen[a:b].all():
            take[i] = True
            seen[max(0, a - PERIOD + 1) : b + PERIOD - 1] = True
    return asked.filter(pa.array(take))


def _ask_samples(depth: int):
    """Requests for what tied samples should equal, and the stretches of suffixes within their reach, as rows without a source."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            starts, ranks = samples(block.data, block.off, depth - PERIOD + 1)
            has, source, place = tied(block, starts, ranks)
            starts = starts[has]
            yield longest(wanted(block.number, starts, source[has], place[has], depth - PERIOD + 1, depth - PERIOD), len(block.data))
            begin, end = runs(in_reach(len(block.data), starts, PERIOD - 1), block.off)
            columns = (np.full(len(begin), block.number), begin, np.full(len(begin), -1), begin, end - begin)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "here", "source", "place", "n"])

    return ask


def _doubtful(block: Block, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and fingerprints of the suffixes within reach of a tied sample, and whether step 2 left each open."""
    among = covered(len(block.data), *(x.to_numpy() for x in listed(block, "doubt", "here", "n")))
    if not among.any():
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    starts, fps = fingerprints(block.data, block.off, depth, among)
    return starts, fps, ~resolved(block, "passages", depth)[1][starts]


def second(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A second fingerprint, of 32 bits, from 24 of a string's bytes."""
    eight, out = np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), 0, (1,)), np.zeros(len(starts), U64)
    for k in (depth - 8, depth // 2, 0):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
        out += eight[starts + k]
    return (mix(out) >> U64(32)).astype(np.uint32)


def _emit_suffixes(depth: int):
    def emit(block: Block) -> Iterator[tuple[np.ndarray, dict]]:
        starts, fps, still = _doubtful(block, depth)
        distinct, first, _ = first_of(fps)
        need = np.zeros(len(distinct), np.uint8)
        need[np.searchsorted(distinct, fps[still])] = 1
        yield distinct, {"place": starts[first].astype(np.uint32), "check": second(block.data, starts[first], depth), "need": need}

    return emit


def _ask_suffixes(depth: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            starts, fps, still = _doubtful(block, depth)
            has, source, place = tied(block, starts, fps)
            has &= still
            yield wanted(block.number, starts[has], source[has], place[has], depth, depth - 1)

    return ask


@ends_shuffles
def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes)."""
    if depth < 2 * PERIOD:
        raise ValueError(f"depth must be at least {2 * PERIOD}")
    bounded(docs.sparkSession)
    held = corpus(docs, id_col, text_col)
    ranks = keep(exchange(held.blocks, held.n_blocks, _emit_samples(depth), held.n_bytes * len(COVER) / PERIOD), "ranks")
    asked = keep(told(held.blocks, ranks).mapInArrow(_ask_samples(depth), WANT), "asked")
    drop_kept(ranks)
    passages = keep(fetched(held.blocks, asked.where("source >= 0"), _passage(PERIOD - 1), "passages"), "passages")
    doubt = asked.where("source < 0").groupBy("block").agg(F.collect_list(F.struct("here", "n")).alias("doubt"))
    doubt = keep(doubt, "doubt")
    drop_kept(asked)
    both = told(held.blocks, passages, doubt)
    ties = keep(exchange(both, held.n_blocks, _emit_suffixes(depth), held.n_bytes / 4, extra={"need": np.uint8}), "ties")
    asked = keep(told(both, ties).mapInArrow(_ask_suffixes(depth), WANT), "asked")
    drop_kept(ties, doubt)
    more = keep(fetched(held.blocks, asked, _passage(0), "more"), "more")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            yield _cut(block, depth, with_text)

    schema = "key binary, copies long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    done = told(held.blocks, passages, more).mapInArrow(cut, schema)
    out = held.ids.join(done, "key", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    pick = lambda name, value: F.when(copy, value).otherwise(F.col(name)).alias(name)
    columns = ["doc_id", "n_bytes", pick("n_removed", F.col("n_bytes")), pick("n_spans", F.lit(1).cast("long")), pick("kept_sha256", F.lit(NOTHING))]
    return out.select(*columns, *([pick("kept", F.lit(b""))] if with_text else []))


def _cut(block: Block, depth: int, with_text: bool) -> pa.RecordBatch:
    gone = resolved(block, "passages", depth)[0] | resolved(block, "more", depth)[0]
    shas, removed, spans_, kept = [], [], [], []
    for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True):
        lost = gone[a:b]
        rest = block.data[a:b][~lost].tobytes()
        removed.append(b - a - len(rest))
        spans_.append(int(np.count_nonzero(lost[1:] & ~lost[:-1]) + (len(lost) > 0 and lost[0])))
        shas.append(hashlib.sha256(rest).hexdigest())
        if with_text:
            kept.append(rest)
    columns = {"key": pa.array(block.keys, pa.binary()), "copies": block.more["copies"].values, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
    if with_text:
        columns["kept"] = pa.array(kept, pa.binary())
    return pa.RecordBatch.from_pydict(columns)
