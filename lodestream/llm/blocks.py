"""Blocks of distinct texts, exchanges of packed fingerprints between them, and passages fetched from one to another.

A block row holds about `BLOCK_BYTES` of distinct texts, compressed, ordered by document id. Steps
of the deduplication operators run over whole blocks. A step sends each block's sorted
fingerprints, packed by bucket of fingerprint order; buckets are sorted one at a time, and a block
gets back which of its fingerprints other blocks hold too and where one of these stands. Fingerprints
only propose: the passage itself is then fetched from there and compared.

Within a block a fingerprint is sent once, so a passage that a third of all texts share puts one
entry per block into its bucket, however often it occurs. Where there are more than `MEMBERS`
blocks, a bucket is first settled among `MEMBERS` of them at a time, and one entry of each such
group goes on to the bucket's second round, so no group grows with the corpus.

A row of an exchange holds `ROW_ENTRIES` entries or more however many buckets there are: a task
gathers `FLUSH` entries and cuts them into at most FLUSH / ROW_ENTRIES buckets. Beyond that number
buckets are dealt in two levels: first in ranges of buckets, then each range, which one task reads in
a stream, is gathered again and cut into its own buckets. Either level moves packed rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop_kept, keep, keep_bucketed, tidy
from .textblock import U64

BLOCK_BYTES = 2 << 20
BUCKET_ENTRIES = 1 << 20
FLUSH, ROW_ENTRIES = 3 << 20, 150
MEMBERS, MAX_BUCKETS = 4096, 100_000
NO_ID = -(1 << 63)


@dataclass
class Corpus:
    ids: DataFrame  # doc_id, key: every row
    blocks: DataFrame  # block, ids, keys, lens, copies, size, blob: distinct texts with their smallest id
    n_blocks: int
    n_bytes: int


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


def corpus(docs: DataFrame, id_col: str, text_col: str) -> Corpus:
    """Distinct texts in blocks. The text is shuffled once, by document, so copies of one text never meet in one task."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    ids = keep(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    firsts = keep(ids.groupBy("key").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).select("key", "first.doc_id", "copies", "n_bytes"), "firsts")
    n_bytes = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_blocks)).alias("block")
    both = rows.select(block, "doc_id", "key", "text", F.lit(0).cast("long").alias("copies")).unionByName(firsts.select(block, "doc_id", "key", F.lit(None).cast("string").alias("text"), "copies"))
    packed = both.groupBy("block").applyInArrow(_pack, "block long, ids array<long>, keys binary, lens array<long>, copies array<long>, size long, blob binary")
    blocks = keep_bucketed(packed, "blocks", "block", max(1, min(MAX_BUCKETS, math.ceil(n_blocks / 4))))
    drop_kept(firsts)
    return Corpus(ids, blocks, n_blocks, n_bytes)


def _pack(table: pa.Table) -> pa.Table:
    ids, keys, texts = table.column("doc_id").to_pylist(), table.column("key").to_pylist(), table.column("text")
    wanted = {(i, k): c for i, k, none, c in zip(ids, keys, texts.is_null().to_pylist(), table.column("copies").to_pylist(), strict=True) if none}
    rows = []
    for n, pair in enumerate(zip(ids, keys, strict=True)):
        if pair in wanted and texts[n].is_valid:
            rows.append((NO_ID if pair[0] is None else pair[0], pair[1], n, wanted.pop(pair)))
    rows.sort()
    raw = [texts[n].as_py().encode() for _, _, n, _ in rows]
    data = b"".join(raw)
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()] if rows else [], pa.int64()),
            "ids": pa.array([[r[0] for r in rows]] if rows else [], pa.list_(pa.int64())),
            "keys": pa.array([b"".join(r[1] for r in rows)] if rows else [], pa.binary()),
            "lens": pa.array([[len(x) for x in raw]] if rows else [], pa.list_(pa.int64())),
            "copies": pa.array([[r[3] for r in rows]] if rows else [], pa.list_(pa.int64())),
            "size": pa.array([len(data)] if rows else [], pa.int64()),
            "blob": pa.array([pa.compress(data, codec="zstd", asbytes=True)] if rows else [], pa.binary()),
        }
    )


@dataclass
class Block:
    number: int
    ids: np.ndarray
    keys: list[bytes]
    data: np.ndarray
    off: np.ndarray
    found: np.ndarray  # sorted fingerprints that this block was told of
    source: np.ndarray  # of each, a block that holds it
    place: np.ndarray  # and where it starts there
    more: dict  # further columns of the row


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {k: batch.column(names.index(k))[i] for k in names}
            size = row["size"].as_py()
            data = np.frombuffer(pa.decompress(row["blob"].as_buffer(), decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
            lens = np.asarray(row["lens"].values.to_numpy(), np.int64)
            keys = row["keys"].as_py()
            found, source, place = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if told := row["found"].as_py() if "found" in names else None:
                found, first = np.unique(np.concatenate([unpack(x["fps"]) for x in told]), return_index=True)
                source, place = (np.concatenate([unplanes(x[k], np.uint32) for x in told])[first].astype(np.int64) for k in ("source", "place"))
            more = {k: v for k, v in row.items() if k not in ("block", "ids", "keys", "lens", "size", "blob", "found")}
            yield Block(row["block"].as_py(), row["ids"].values.to_numpy(), [keys[k : k + 16] for k in range(0, len(keys), 16)], data, np.concatenate([[0], np.cumsum(lens)]), found, source, place, more)
    tidy()


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences: the high planes are mostly zero, which the shuffle's compression removes."""
    d = values.copy()
    d[1:] -= values[:-1]
    return planes(d)


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, U64), dtype=U64)


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    """Ranges of fingerprint order: bucket b holds the values from b / n of the range on."""
    return ((values >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in some column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Sender:
    """Gathers entries of many blocks and yields them sorted and cut by bucket and part. `extra` columns go along with each fingerprint."""

    def __init__(self, n_buckets: int, extra: dict[str, type], flush_at: int = FLUSH):
        self.n, self.extra, self.flush_at, self.held, self.parts = n_buckets, extra, flush_at, 0, {}

    def add(self, values: np.ndarray, part: int = 0, **extra: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(values):
            self.parts.setdefault(part, []).append((values, extra))
            self.held += len(values)
            if self.held >= self.flush_at:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("bucket", "part", "fps", *self.extra)}
        for part, held in self.parts.items():
            values = np.concatenate([v for v, _ in held])
            order = np.argsort(values)
            values = values[order]
            bucket = bucket_of(values, self.n)
            cut = np.flatnonzero(starts_of(bucket))
            ranges = list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True))
            out["bucket"] += [b for b, _, _ in ranges]
            out["part"] += [part] * len(ranges)
            out["fps"] += [pack(values[a:b]) for _, a, b in ranges]
            for k, kind in self.extra.items():
                column = np.concatenate([e[k] for _, e in held])[order].astype(kind)
                out[k] += [planes(column[a:b]) for _, a, b in ranges]
        self.held, self.parts = 0, {}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("bucket", "part") else pa.binary()) for k, v in out.items()})


def coarse(n_buckets: int) -> int:
    """Buckets of the first level: as many as there are, up to the number that keeps rows full."""
    return min(n_buckets, FLUSH // ROW_ENTRIES)


def refined(sent: DataFrame, n_buckets: int, extra: dict[str, type]) -> DataFrame:
    """Rows of the first level, cut into the buckets of the second where there is one."""
    if coarse(n_buckets) == n_buckets:
        return sent

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, last = Sender(n_buckets, extra), None
        for batch in batches:
            columns = {k: batch.column(batch.schema.names.index(k)) for k in batch.schema.names}
            for i in range(batch.num_rows):
                bucket = columns["bucket"][i].as_py()
                if bucket != last and sender.held:
                    yield sender.flush()
                last = bucket
                more = {k: unplanes(columns[k][i].as_py(), kind) for k, kind in extra.items()}
                yield from sender.add(unpack(columns["fps"][i].as_py()), columns["part"][i].as_py(), **more)
        if sender.held:
            yield sender.flush()
        tidy()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(split, sent.schema)


Emit = Callable[[Block], Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]]
#: What goes along with a fingerprint: its block, where it starts there, and 32 bits of a second fingerprint.
ENTRY = {"block": np.uint32, "place": np.uint32, "check": np.uint32}


def exchange(blocks: DataFrame, n_blocks: int, emit: Emit, entries: float, later: bool = False, extra: dict[str, type] | None = None) -> DataFrame:
    """Sends each block's fingerprints to their buckets, sorts one bucket at a time and returns (block, found), packed.

    Told of a fingerprint is every block that shares it with another; with `later`, all but the first
    by the column `doc`, block and place. A column `need` says which entries are told at all.
    """
    extra = ENTRY | (extra or {})
    n_buckets, n_parts = max(1, math.ceil(entries / BUCKET_ENTRIES)), max(1, math.ceil(n_blocks / MEMBERS))
    first_level = coarse(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(first_level, extra)
        for block in opened(batches):
            for values, more in emit(block):
                yield from sender.add(values, block.number % n_parts, block=np.full(len(values), block.number, np.uint32), **more)
        if sender.held:
            yield sender.flush()
        tidy()

    def settle(last: bool) -> Callable[[pa.Table], pa.Table]:
        def one(table: pa.Table) -> pa.Table:
            values = np.concatenate([unpack(x.as_py()) for x in table.column("fps")])
            columns = {k: np.concatenate([unplanes(x.as_py(), kind) for x in table.column(k)]) for k, kind in extra.items()}
            order = np.lexsort((columns["place"], columns["block"], *([columns["doc"]] if "doc" in extra else []), columns["check"], values))
            values, columns = values[order], {k: v[order] for k, v in columns.items()}
            new = starts_of(values, columns["check"])
            at = np.flatnonzero(new)
            first = at[np.cumsum(new) - 1] if len(at) else at
            size = np.diff(np.append(at, len(values)))
            told = ~new if later else np.repeat(size > 1, size)
            if "need" in extra:
                told &= columns["need"] > 0
            told = np.flatnonzero(told)
            source = np.where(first[told] == told, told + 1, first[told])  # the first of its like, and for the first itself the second
            to = columns["block"][told]
            order = np.argsort(to, kind="stable")
            told, source, to = told[order], source[order], to[order]
            cut = np.flatnonzero(starts_of(to)).tolist()
            ends = [*cut[1:], len(to)] if cut else []
            out = {
                "block": [int(to[a]) for a in cut],
                "fps": [pack(values[told[a:b]]) for a, b in zip(cut, ends, strict=True)],
                "source": [planes(columns["block"][source[a:b]]) for a, b in zip(cut, ends, strict=True)],
                "place": [planes(columns["place"][source[a:b]]) for a, b in zip(cut, ends, strict=True)],
            }
            if not last:  # one of each goes on to the second round
                out = {k: [*v, None] for k, v in out.items()} | {"bucket": [None] * len(cut) + [table.column("bucket")[0].as_py()]}
                out["fps"][-1], out["place"][-1] = pack(values[at]), planes(columns["place"][at])
                for k in extra:
                    if k != "place":
                        out[f"next_{k}"] = [None] * len(cut) + [planes(columns[k][at])]
            tidy()
            return pa.table({k: pa.array(v, pa.int64() if k in ("block", "bucket") else pa.binary()) for k, v in out.items()})

        return one

    schema = "bucket long, part long, fps binary, " + ", ".join(f"{k} binary" for k in extra)
    back = "block long, fps binary, source binary, place binary"
    dealt = refined(blocks.mapInArrow(send, schema), n_buckets, extra)
    if n_parts == 1:
        found = dealt.groupBy("bucket").applyInArrow(settle(True), back)
    else:
        more = [k for k in extra if k != "place"]
        first = keep(dealt.groupBy("bucket", "part").applyInArrow(settle(False), back + ", bucket long, " + ", ".join(f"next_{k} binary" for k in more)), "settled")
        rest = first.where("bucket is not null").select("bucket", "fps", "place", *[F.col(f"next_{k}").alias(k) for k in more])
        found = first.where("bucket is null").select("block", "fps", "source", "place").unionByName(rest.groupBy("bucket").applyInArrow(settle(True), back))
    return found.groupBy("block").agg(F.collect_list(F.struct("fps", "source", "place")).alias("found"))


def told(blocks: DataFrame, *found: DataFrame) -> DataFrame:
    for f in found:
        blocks = blocks.join(f, "block", "left")
    return blocks


#: A passage that a block asks for: `n` places from `place` on in block `source`, to be held against its own from `here` on.
WANT = "block long, here long, source long, place long, n long"
SPAN = 1 << 16


def wanted(number: int, here: np.ndarray, source: np.ndarray, place: np.ndarray, width: int, reach: int) -> pa.RecordBatch:
    """Requests for strings of `width` places that start at `here`, and should equal those at `place`.

    Strings with the same offset that start at most `reach` apart are one passage; with a reach below the strings' true length, none crosses a text.
    """
    order = np.lexsort((here, place - here, source))
    here, source, place = here[order], source[order], place[order]
    new = starts_of(source, place - here)
    new[1:] |= np.diff(here) > reach
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(here)) - 1 if len(cut) else cut
    columns = (np.full(len(cut), number), here[cut], source[cut], place[cut], here[last] - here[cut] + width)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "here", "source", "place", "n"])


def fetched(blocks: DataFrame, wants: DataFrame, cut: Callable[[Block, int, int], tuple[int, bytes]], label: str) -> DataFrame:
    """(block, texts) for requests: the passages, cut by the blocks that hold them. A passage that many blocks ask for is cut once."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            asked = block.more["asked"].as_py()
            got = [cut(block, x["place"], x["n"]) for x in asked]
            yield pa.RecordBatch.from_pydict(
                {
                    "source": pa.array([block.number] * len(asked), pa.int64()),
                    "place": pa.array([x["place"] for x in asked], pa.int64()),
                    "n": pa.array([x["n"] for x in asked], pa.int64()),
                    "left": pa.array([x for x, _ in got], pa.int64()),
                    "text": pa.array([x for _, x in got], pa.binary()),
                }
            )

    asked = wants.select("source", "place", "n").distinct().groupBy("source", F.floor(F.col("place") / SPAN).alias("span")).agg(F.collect_list(F.struct("place", "n")).alias("asked"))
    answers = keep(blocks.join(asked.select(F.col("source").alias("block"), "asked"), "block").mapInArrow(answer, "source long, place long, n long, left long, text binary"), f"{label}-answers")
    return wants.join(answers, ["source", "place", "n"]).groupBy("block").agg(F.collect_list(F.struct("here", "source", "place", "n", "left", "text")).alias(label))
