"""Language identification by fusing evidence.

Text: naive Bayes over hashed character trigrams of the whole text, trained on all rows that
declare a language, one count per language and trigram. Declared language: how often rows of each
language declare what, learned from the texts' own verdicts. Address suffix and host: the mix of
languages at this suffix and host, the host smoothed towards its domain, the domain towards its
suffix and the suffix towards the whole corpus, all by grouped aggregation of the texts' verdicts.
Log evidence is added and normalised.

No row is evidence for itself: its trigrams are taken out of the counts of the language that it
declares, and its verdict out of the sums of its declaration, host, domain, suffix and corpus,
before it is judged. A row alone at its host is thus judged by its domain, suffix and the rest.

Every declared language counts. The trigram table has a fixed number of cells a language and holds
only those that occur, so a rare language takes little of what is broadcast; each row's evidence
has one number per language. Sums of declarations are broadcast while they are within a stated
size. Hosts are joined by key, never broadcast; a host with a third of all rows is pre-aggregated
in each task, and Spark may split its side of the join.

Null and empty texts give no text evidence; null or unknown declarations, suffixes and hosts give
none of theirs. Repeated rows get equal results, and are evidence for one another; ties go to the
language that sorts first. Without any declared language the result is null. A text of any length
is read whole, by one worker. An empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import keep
from .textblock import U64, pieces

CELLS, GROUPS, HELD = 1 << 15, 8, 256
TEMPER, MAX_EVIDENCE, SMOOTH = 0.2, 30.0, 10.0
BROADCAST_LANGUAGES = 1_000  # the sums of declarations are languages squared numbers: 8 MB


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the three-byte windows that stay in one text, and their texts' bounds among them."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    x = data.astype(np.uint32)
    cell = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)
    valid = np.ones(n - 2, bool)
    cut = off[1:-1]
    for back in (1, 2):
        at = cut - back
        valid[at[(at >= 0) & (at < n - 2)]] = False
    before = np.zeros(n - 1, np.int64)
    np.cumsum(valid, out=before[1:])
    return cell[valid].astype(np.int64), before[np.minimum(off, n - 2)]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _counts(rows: DataFrame, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By language, the trigram cells that occur in rows that declare it, and their counts."""
    number = {x: k for k, x in enumerate(languages)}

    def packed(x: np.ndarray) -> bytes:
        return pa.compress(x.tobytes(), "zstd", asbytes=True)

    def sums(columns: dict[str, list[int]], counts: list[np.ndarray]) -> dict[str, pa.Array]:
        cells = [np.flatnonzero(c) for c in counts]
        out = {k: pa.array(v, pa.int64()) for k, v in columns.items()}
        out["n"] = pa.array([len(c) for c in cells], pa.int64())
        out["cells"] = pa.array([packed(c.astype(np.uint16)) for c in cells], pa.binary())
        out["counts"] = pa.array([packed(x[c]) for x, c in zip(counts, cells, strict=True)], pa.binary())
        return out

    def unpacked(n: int, cells: pa.Buffer, counts: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(pa.decompress(cells, 2 * n, "zstd"), np.uint16), np.frombuffer(pa.decompress(counts, 8 * n, "zstd"), np.int64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        group = TaskContext.get().partitionId() % GROUPS

        def sent() -> pa.RecordBatch:
            out = sums({"which": list(held), "part": [group] * len(held)}, list(held.values()))
            held.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            which = np.array([number[x] for x in batch.column(0).to_pylist()])
            for lo, _, data, off in pieces(_lowered(batch.column(1))):
                cells, at = trigrams(data, off)
                here = which[lo : lo + len(off) - 1]
                seen, place = np.unique(here, return_inverse=True)
                owner = np.repeat(place, np.diff(at))
                order = np.argsort(owner.astype(np.uint16) if len(seen) < 1 << 16 else owner, kind="stable") if len(seen) > 1 else slice(None)
                cells, bounds = cells[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(seen)))])
                for k, a, b in zip(seen.tolist(), bounds, bounds[1:], strict=False):
                    found = np.bincount(cells[a:b], minlength=CELLS)
                    held[k] = held[k] + found if k in held else found
                    if len(held) >= HELD:
                        yield sent()
        if held:
            yield sent()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for row in zip(*(table.column(c) for c in ("n", "cells", "counts")), strict=True):
            cells, counts = unpacked(row[0].as_py(), row[1].as_buffer(), row[2].as_buffer())
            total[cells] += counts
        return pa.table(sums({"which": [table.column("which")[0].as_py()]}, [total]))

    kind = "n long, cells binary, counts binary"
    parts = rows.select("declared", "text").mapInArrow(part, f"which long, part long, {kind}").groupBy("which", "part").applyInArrow(add, f"which long, {kind}")
    totals: dict[int, np.ndarray] = {}
    empty = np.zeros(0, np.int64)
    for row in parts.toLocalIterator():
        cells, counts = unpacked(row.n, row.cells, row.counts)
        old_cells, old = totals.get(row.which, (empty, empty))
        both, at = np.unique(np.concatenate([old_cells, cells]), return_inverse=True)
        totals[row.which] = both.astype(np.uint16), np.bincount(at, np.concatenate([old, counts]), len(both)).astype(np.int64)
    return [totals.get(k, (empty.astype(np.uint16), empty)) for k in range(len(languages))]


def likelihoods(cells: np.ndarray, at: np.ndarray, own: np.ndarray, table: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log likelihood of every text in every language, in its own (-1 for none) by the counts without it."""
    size = np.diff(at)
    whole = np.array([counts.sum() + 0.5 * CELLS for _, counts in table])
    sums = np.zeros((len(size), len(table)))
    c = np.zeros(len(cells) + 1)
    for k, (some, counts) in enumerate(table):
        weight = np.full(CELLS, np.log(0.5))
        weight[some] = np.log(counts + 0.5)
        np.cumsum(weight[cells], out=c[1:])
        sums[:, k] = c[at[1:]] - c[at[:-1]] - size * np.log(whole[k])
    told = np.flatnonzero((own >= 0) & (size > 0))
    text = np.repeat(np.arange(len(size)), size)
    mine = own[text] >= 0
    pairs = np.sort(text[mine] * CELLS + cells[mine])
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    times = np.diff(first, append=len(pairs))
    text, cell = np.divmod(pairs[first], CELLS)
    rest = np.zeros(len(first))
    for k in np.unique(own[told]).tolist():
        dense = np.zeros(CELLS)
        dense[table[k][0]] = table[k][1]
        here = own[text] == k
        rest[here] = dense[cell[here]] - times[here]
    left = np.bincount(text, times * np.log(rest + 0.5), len(size))
    sums[told, own[told]] = left[told] - size[told] * np.log(whole[own[told]] - size[told])
    return sums


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _share(held: Column, p: Column, parent: Column) -> Column:
    """Shares of the languages in sums that hold the row itself (p), without it, smoothed towards the parent's."""
    rest = F.zip_with(F.zip_with(held, p, lambda x, y: x - y), parent, lambda x, q: x + SMOOTH * q)
    share = F.transform(rest, lambda x: x / (_total(held) - _total(p) + SMOOTH))
    return F.when(held.isNull(), parent).otherwise(share)


def apply(rows: DataFrame, id_col: str, text_col: str, declared_col: str | None = None, host_col: str | None = None, suffix_col: str | None = None) -> DataFrame:
    """One row per input row: id, lang, probability, text_lang, declared, n_chars."""
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else F.lower(rows[c].cast("string"))
    rows = rows.select(rows[id_col].alias("id"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"), F.substring_index(pick(declared_col), "-", 1).alias("declared"), pick(host_col).alias("host"), pick(suffix_col).alias("suffix"))
    known = rows.where("declared is not null and declared != ''").groupBy("declared").count()
    languages = sorted(r.declared for r in known.collect())
    if not languages:
        return rows.select("id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", F.length("text").cast("long").alias("n_chars"))
    n, number = len(languages), {x: k for k, x in enumerate(languages)}
    table = rows.sparkSession.sparkContext.broadcast(_counts(rows.where("declared is not null and declared != ''"), languages))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(2).to_pylist()], np.int64)
            for lo, hi, data, off in pieces(_lowered(batch.column(1))):
                sums = likelihoods(*trigrams(data, off), own[lo:hi], counts)
                sums -= sums.max(1, keepdims=True)
                sums = np.maximum(sums * TEMPER, -MAX_EVIDENCE)
                ll = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), n).cast(pa.list_(pa.float64()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pc.cast(pc.utf8_length(part.column(1)), pa.int64()), ll], names=["id", "declared", "host", "suffix", "n_chars", "ll"])

    kind = rows.schema["id"].dataType.simpleString()
    texts = keep(rows.mapInArrow(read, f"id {kind}, declared string, host string, suffix string, n_chars long, ll array<double>"), "texts")
    texts = texts.withColumn("e", F.transform("ll", F.exp)).withColumn("p", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))")).drop("e")

    sums = F.array(*[F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)) for k in range(n)])
    mass = lambda df, name, *keys: df.groupBy(*keys).agg(sums.alias(name))
    vector = lambda x: F.lit([float(v) for v in x])
    p = F.col("p")
    prior = _share(vector(mass(texts, "all").first()[0]), p, vector([1 / n] * n))
    said = mass(texts.where("declared != ''"), "said_held", "declared").withColumnRenamed("declared", "said")
    spoken = vector(said.agg(F.array(*[F.coalesce(F.sum(F.col("said_held")[k]), F.lit(0.0)) for k in range(n)])).first()[0])
    if n <= BROADCAST_LANGUAGES:
        said = F.broadcast(said)
    fused = texts.join(said, F.col("declared") == F.col("said"), "left")
    if host_col or suffix_col:
        fused = fused.withColumn("domain", domain_of(F.col("host")))
        placed = texts.withColumn("domain", domain_of(F.col("host"))).where("host is not null or suffix is not null")
        hosts = mass(placed, "host_held", "host", "domain", "suffix")
        up = lambda name, *keys: hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("host_held")[k]) for k in range(n)]).alias(name))
        hosts = keep(hosts, "hosts")
        suffixes = up("suffix_held", "suffix").where("suffix is not null")
        domains = up("domain_held", "domain", "suffix").where("domain != ''").select(F.col("domain").alias("d"), F.col("suffix").alias("s"), "domain_held")
        hosts = hosts.join(suffixes, "suffix", "left").join(domains, (F.col("domain") == F.col("d")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
        hosts = hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), F.when(F.col("host").isNotNull(), F.col("host_held")).alias("host_held"), "domain_held", "suffix_held")
        fused = fused.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
        fused = fused.withColumn("prior", prior)
        for level in ("suffix_held", "domain_held", "host_held"):
            fused = fused.withColumn("prior", _share(F.col(level), p, F.col("prior")))
    else:
        fused = fused.withColumn("prior", prior)
    # P(declared | language) over the texts' verdicts, smoothed towards an even share, without this row
    heard = F.zip_with(F.zip_with("said_held", p, lambda x, y: x - y + SMOOTH / n), F.zip_with(spoken, p, lambda x, y: x - y + SMOOTH), lambda x, y: F.ln(x / y))
    fused = fused.withColumn("d", F.coalesce(heard, F.array_repeat(F.lit(0.0), n)))
    fused = fused.withColumn("z", F.expr("transform(ll, (x, i) -> x + d[i] + ln(prior[i]))")).withColumn("top", F.array_max("z"))
    names = F.lit(languages)
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    probability = F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - top))")
    return fused.select("id", best(F.col("z")).alias("lang"), probability.alias("probability"), F.when(F.col("n_chars") > 2, best(F.col("ll"))).alias("text_lang"), "declared", "n_chars")
