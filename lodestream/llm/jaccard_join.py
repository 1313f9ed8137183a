"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct `shingle`-word shingles, as fingerprints; their numeric order is the
global order of n-grams. Texts with equal sets are one node. Two nodes link when
100 * intersection >= threshold * union.

1. The global order puts n-grams that are seldom first: a table of `CELLS` counters, summed over
   all texts, gives each n-gram a class of frequency, and fingerprints order a class. The table has
   a fixed size; however full it is, the order is the same everywhere, which is all that
   exactness needs. It only serves to keep n-grams of very common passages out of step 2.
2. Candidates. Linked sets of n n-grams share one among the first n - ceil(n * threshold / 100) + 1
   of each in this order, so only these prefixes are exchanged. Members of an n-gram's group are
   paired with one pivot for each window of sizes, not with each other.
3. Verification. A parity sketch of 1024 bits bounds the difference of two sets from below and
   drops pairs that cannot link. The other sets are cut into `FRAGMENTS` vertical fragments of the
   order of fingerprints; each fragment's overlap is counted on its own and summed per pair.
4. A pair that was never compared consists of two members of one pivot's groups, and can only
   matter when one of them failed against that pivot. Those are compared with the other members of
   their pivots that are outside their component, unless sketches or distances from the pivot (the
   Jaccard distance is a metric) rule a link out; a pair with several pivots is taken once.
5. Connected components of all links.

Copies are collapsed first, with a minimum per set that every task pre-aggregates, so a group of
copies of any size is one node; a group of near copies costs one comparison per member.

Texts without words have an empty set and are linked with nothing. Rows that share an id are one
node of the graph; a null id counts as the smallest and is given back as null. Repeated rows get
equal results. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BUCKET_ENTRIES, NO_ID, Sender, coarse, refined, unpack, unplanes
from .components import components
from .tables import bounded, drop_kept, ends_shuffles, keep, tidy
from .textblock import U64, Words, mix, pieces, windows

SHINGLE, THRESHOLD, FRAGMENTS = 3, 90, 4
CELLS, GROUPS, WORDS = 1 << 22, 8, 16
SENT = {"ref": np.uint64, "n": np.uint32, "rank": np.uint32}
SKETCH = tuple(f"k{i}" for i in range(WORDS))


def sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text and their bounds. Texts with fewer words have the whole sequence as one."""
    words = Words(data, off, lower=True)
    hashes, count = words.hashes(), words.counts()
    at, fp = words.windows(hashes, shingle)
    doc = words.doc[at]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = [windows(hashes[words.at[d] : words.at[d + 1]], int(count[d]))[0] for d in short.tolist()]
        doc = np.concatenate([doc, short])
        fp = np.concatenate([fp, mix(np.array(whole, U64) + U64(1))])  # apart from shingles of the full length
    order = np.lexsort((fp, doc))
    doc, fp = doc[order], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
    doc, fp = doc[new], fp[new]
    return fp, np.searchsorted(doc, np.arange(len(off)))


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def sketches(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams in each of 1024 cells: a row of 16 words per set."""
    cell = np.repeat(np.arange(len(at) - 1), np.diff(at)) * WORDS + ((grams >> U64(6)) & U64(WORDS - 1)).astype(np.int64)
    out = np.zeros((len(at) - 1) * WORDS, U64)
    np.bitwise_xor.at(out, cell, U64(1) << (grams & U64(63)))
    return out.reshape(-1, WORDS)


def prefixes(grams: np.ndarray, at: np.ndarray, classes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of each set in the global order, as many as a linked set must share one of; and their bounds."""
    size = np.diff(at)
    length = np.where(size > 0, size + (-threshold * size) // 100 + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((grams, classes[(grams & U64(CELLS - 1)).astype(np.int64)], doc))
    first = np.arange(len(grams)) - at[doc] < length[doc]
    return grams[order][first], np.concatenate([[0], np.cumsum(length)])


def frequency_classes(docs: DataFrame, shingle: int) -> np.ndarray:
    """A class of frequency, 0 to 255, for each cell of fingerprints, from all texts. Partial tables are summed in GROUPS groups."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, data, off in pieces(batch.column(0)):
                words = Words(data, off, lower=True)
                cells, n = np.unique((words.windows(words.hashes(), shingle)[1] & U64(CELLS - 1)).astype(np.int64), return_counts=True)
                counts[cells] += n.astype(np.uint32)
        tidy()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int64()), "sums": pa.array([pa.compress(counts.tobytes(), "zstd", asbytes=True)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.uint32)
        for x in table.column("sums"):
            total += np.frombuffer(pa.decompress(x.as_buffer(), CELLS * 4, "zstd"), np.uint32)
        return pa.table({"sums": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    total = np.zeros(CELLS, np.float64)
    for r in docs.select("text").mapInArrow(part, "part long, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect():
        total += np.frombuffer(pa.decompress(r.sums, CELLS * 4, "zstd"), np.uint32)
    return np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)


def keys(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set."""
    return np.stack([summed(mix(grams + U64(1)), at), summed(mix(grams ^ U64(0x5DEECE66D5DEECE6)), at)], 1)


def described(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """doc_id, text_key, key, n, sketch and prefix of every text of (doc_id, text, text_key)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, shingle))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1)):
                grams, at = sets(data, off, shingle)
                first, cut = prefixes(grams, at, classes, threshold)
                words = sketches(grams, at).view(np.int64)
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), binary(keys(grams, at)), pa.array(np.diff(at)), binary(np.split(first, cut[1:-1])), *[pa.array(words[:, i]) for i in range(WORDS)]],
                    names=["doc_id", "text_key", "key", "n", "prefix", *SKETCH],
                )
        tidy()

    return docs.mapInArrow(describe, "doc_id long, text_key long, key binary, n long, prefix binary, " + ", ".join(f"{k} long" for k in SKETCH))


def star(n: np.ndarray, rank: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pivots of a group sorted by size, each with all members of a fitting size.

    The sizes are cut into windows, each beginning with the first size too large for the window
    before. A window's pivot is the member that has the n-gram earliest in its order: of near copies
    the one with the fewest n-grams of its own, and so the same one for most of their n-grams. Any
    two members that fit each other are both members of the pivot of the larger one's window.
    """
    p = 0
    while p < len(n):
        low, high = int(np.searchsorted(n, -(-n[p] * threshold // 100))), int(np.searchsorted(n, n[p] * 100 // threshold, "right"))
        if high - low > 1:
            pivot = p + int(np.argmin(rank[p:high]))
            yield pivot, np.concatenate([np.arange(low, pivot), np.arange(pivot + 1, high)])
        p = high


def grouped(sigs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal values with two or more entries."""
    cut = np.concatenate([[0], np.flatnonzero(sigs[1:] != sigs[:-1]) + 1, [len(sigs)]])
    for i in np.flatnonzero(np.diff(cut) > 1).tolist():
        yield int(cut[i]), int(cut[i + 1])


def candidates(rows: DataFrame, entries: float, threshold: int) -> DataFrame:
    """Pairs (pivot, member) of references to verify; a reference is the first half of a key."""
    n_buckets = max(1, math.ceil(entries * 2 / BUCKET_ENTRIES))
    first_level = coarse(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(first_level, SENT)
        for batch in batches:
            name = batch.schema.names.index
            blobs, named_ = batch.column(name("prefix")).to_pylist(), batch.column(name("key")).to_pylist()
            take = list({k: i for i, k in enumerate(named_) if blobs[i]}.values())  # copies in one batch are sent once
            count = np.array([len(blobs[i]) // 8 for i in take], np.int64)
            ref, n = np.frombuffer(b"".join(named_[i][:8] for i in take), U64), batch.column(name("n")).to_numpy()[take]
            rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield from sender.add(np.frombuffer(b"".join(blobs[i] for i in take), U64), ref=np.repeat(ref, count), n=np.repeat(n, count), rank=rank)
        if sender.held:
            yield sender.flush()
        tidy()

    def pair(table: pa.Table) -> pa.Table:
        grams = np.concatenate([unpack(x.as_py()) for x in table.column("fps")])
        ref, n, rank = (np.concatenate([unplanes(x.as_py(), SENT[k]) for x in table.column(k)]) for k in ("ref", "n", "rank"))
        order = np.lexsort((ref, n, grams))
        grams, ref, n, rank = grams[order], ref[order], n[order].astype(np.int64), rank[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (ref[1:] != ref[:-1])
        grams, ref, n, rank = grams[new], ref[new], n[new], rank[new]
        pivot, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in grouped(grams):
            for p, members in star(n[lo:hi], rank[lo:hi], threshold):
                pivot.append(np.full(len(members), lo + p))
                member.append(lo + members)
        pairs = np.unique(np.stack([ref[np.concatenate(pivot)], ref[np.concatenate(member)]], 1), axis=0)
        raw = [np.ascontiguousarray(pairs[:, i]).tobytes() for i in (0, 1)]
        tidy()
        return pa.table({k: pa.array([x[i : i + 8] for i in range(0, len(x), 8)], pa.binary()) for k, x in zip(("ref_a", "ref_b"), raw, strict=True)})

    schema = "bucket long, part long, fps binary, " + ", ".join(f"{k} binary" for k in SENT)
    return refined(rows.mapInArrow(send, schema), n_buckets, SENT).groupBy("bucket").applyInArrow(pair, "ref_a binary, ref_b binary").distinct()


def may_link(threshold: int) -> Column:
    """Whether sizes and sketches of sides a and b allow a link."""
    differ = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH), F.lit(0))
    least = F.greatest(differ, F.abs(F.col("n_a") - F.col("n_b")))
    return least * (100 + threshold) <= (100 - threshold) * (F.col("n_a") + F.col("n_b"))


def sides(members: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    return tuple(members.select(*[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", *SKETCH, *more)]) for x in "ab")


def uncompared(stars: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with a common pivot, of which one failed against it, in different components.

    `stars` has (pivot, key, far, linked), with no distance where the sketches settled it; `members` (key, component, n, sketch).
    """
    told = stars.join(members, "key").join(stars.groupBy("key").agg(F.collect_set("pivot").alias("pivots")), "key")
    a, b = sides(told, "pivot", "component", "far", "linked", "pivots")
    near = (
        (F.col("pivot_a") == F.col("pivot_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.col("linked_b") | (F.col("key_a") < F.col("key_b")))
        & F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) <= (100 - threshold) / 100 + 1e-9, F.lit(True))
        & may_link(threshold)
        & (F.array_min(F.array_intersect("pivots_a", "pivots_b")) == F.col("pivot_a"))
    )
    pairs = a.where("not linked_a").join(b, near)
    return pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def named(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs of whole keys. Two sets whose references agree by chance only make a pair more to verify."""
    a, b = (firsts.select(F.col("key").alias(k), F.substring("key", 1, 8).alias(f"ref_{k}")) for k in "ab")
    return pairs.join(a, "ref_a").join(b, "ref_b").select("a", "b")


def fragments(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, shingle: int, twice: bool) -> DataFrame:
    """(key, part, grams) of the wanted sets, each from the one text that stands for it. `twice`: ids repeat.

    Texts are found by id and a hash of the text, so rows that share an id meet only equal texts.
    """
    rows = firsts.join(wanted, "key", "left_semi").select("key", "doc_id", "text_key")
    texts = docs.join(rows.hint("merge"), ["doc_id", "text_key"]).select("key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1)):
                grams, at = sets(data, off, shingle)
                named = batch.column(0).slice(lo, hi - lo).to_pylist()
                found = keys(grams, at)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                cell = doc * FRAGMENTS + ((grams >> U64(32)) * U64(FRAGMENTS) >> U64(32)).astype(np.int64)
                start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                ok = [named[c // FRAGMENTS] == found[c // FRAGMENTS].tobytes() for c in cell[start].tolist()]
                bounds = np.append(start, len(cell))
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(grams.view(np.int64)))
                batch_out = pa.RecordBatch.from_arrays([pa.array([named[c // FRAGMENTS] for c in cell[start].tolist()], pa.binary()), pa.array(cell[start] % FRAGMENTS, pa.int32()), values], names=["key", "part", "grams"])
                yield batch_out.filter(pa.array(ok, pa.bool_()))
        tidy()

    out = texts.mapInArrow(cut, "key binary, part int, grams array<long>")
    return out.dropDuplicates(["key", "part"]) if twice else out


def verified(pairs: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, common, na, nb): the overlaps of each fragment, counted apart and summed per pair."""
    left, right = (parts.select(F.col("key").alias(k), "part", F.col("grams").alias(f"grams_{k}")) for k in "ab")
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("common"))
    total = pairs.join(partial.groupBy("a", "b").agg(F.sum("common").alias("common")), ["a", "b"], "left").na.fill(0, ["common"])
    na, nb = (sizes.select(F.col("key").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    return total.join(na, "a").join(nb, "b")


@ends_shuffles
def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id. `threshold` is a percentage."""
    return _found(docs, id_col, text_col, shingle, threshold)[0]


def _found(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result and the kept tables that it reads."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be a percentage")
    bounded(docs.sparkSession)
    docs = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    rows = keep(described(docs, shingle, threshold), "sets")
    firsts = keep(rows.where("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n")).select("key", "first.*", "n"), "firsts")
    entries = (rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) / 8
    stars = keep(named(candidates(rows, entries, threshold), firsts), "stars")
    ids = firsts.select("key", "doc_id")
    used = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    members = keep(rows.join(ids.join(used, "key", "left_semi"), ["key", "doc_id"], "left_semi").select("key", "doc_id", "n", *SKETCH).distinct(), "members")
    twice = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    left, right = sides(members)
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(left, F.col("a") == F.col("key_a")).join(right, F.col("b") == F.col("key_b")).where(may_link(threshold))
    pairs = keep(pairs.select("a", "b"), "pairs")
    linked = (F.col("common") * (100 + threshold) >= threshold * (F.col("na") + F.col("nb"))).alias("linked")
    parts = _fragments_of(pairs, docs, firsts, shingle, twice)
    checked = keep(verified(pairs, parts, firsts).select("a", "b", linked, (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far")), "checked")

    def graph(links: DataFrame) -> DataFrame:
        a, b = (ids.select(F.col("key").alias(k), F.col("doc_id").alias(f"id_{k}")) for k in "ab")
        return components(links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))

    links = checked.where("linked").select("a", "b")
    grouped_ = keep(graph(links), "components")
    both = checked.unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "linked", "far"))
    known = keep(stars.join(both, ["a", "b"], "left").select(F.col("a").alias("pivot"), F.col("b").alias("key"), "far", F.coalesce("linked", F.lit(False)).alias("linked")), "known")
    placed = members.join(grouped_, F.col("doc_id") == grouped_["node"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    rest = keep(uncompared(known, placed, threshold).join(checked, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        found = keep(verified(rest, _fragments_of(rest, docs, firsts, shingle, twice), firsts).where(linked).select("a", "b"), "found")
        if found.limit(1).count():
            grouped_ = keep(graph(links.unionByName(found)), "components")
        drop_kept(found)
    for used_up in (stars, members, pairs, parts, checked, known, rest):
        drop_kept(used_up)
    labels = ids.join(grouped_, ids["doc_id"] == grouped_["node"], "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(labels, "key", "left")
    clean = lambda c: F.when(c != NO_ID, c)
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(clean(F.col("doc_id")).alias("doc_id"), "n_shingles", clean(alone).alias("component_id")), [rows, firsts, grouped_]


def _fragments_of(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, twice: bool) -> DataFrame:
    return keep(fragments(docs, firsts, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), shingle, twice), "fragments")


@ends_shuffles
def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns. Of rows with this id, equal texts are kept once and different ones each."""
    out, used = _found(docs, id_col, text_col, shingle, threshold)
    found = keep(out, "found")
    drop_kept(*used)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    out = docs.join(kept.hint("merge"), docs[id_col].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    twice = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates([id_col, text_col]) if twice else out
