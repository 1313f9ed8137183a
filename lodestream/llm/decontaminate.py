"""Benchmark decontamination: BM25 over test items with block-max WAND, then an overlap check.

The test items are the indexed documents and every passage of every training text is a query.
Scores are BM25 impacts divided by the item's score for itself, so one threshold serves all items.

For each batch of texts, the terms that are too weak to reach the threshold together (the
non-essential ones) are set aside by their largest impact in the whole index; a passage is a
candidate only if some item could reach the threshold through its essential terms, judged by exact
essential impacts plus the bound on the others. Candidate passages run block-max WAND over the
posting lists, which returns every item at or above the threshold. Passages are at least twice as
long as the items they are for: items of over `SHORT` words are indexed apart, by doubling length,
and have longer passages of their own. Each such item's question and
answer (the lines before the last, and the last; the whole text if it has one line) are compared
with the passage by `shingle`-word shingles: both must be there, or the item as a whole with at
least a part of its answer.

Items are indexed in shards of at most `shard_items`, so the broadcast index is bounded; a larger
test set takes more passes. Their number, mean length and the words' item counts are those of all
items, counted first and kept on the driver, so scores do not depend on shards. Texts are only
read, never shuffled.

Words are maximal runs of ASCII letters, digits and bytes from 0x80 on, in lower case. Null and
empty texts and items match nothing; an item with fewer words than a shingle is compared as one
shingle. Repeated rows are matched each for themselves; equal items match together. Empty tables
give an empty result; other columns are ignored, whatever their names. A text of any length is cut
into passages by one worker.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import U64, owner, pieces, runs, strings, windows

K1, B, SHINGLE = 1.2, 0.4, 5
THRESHOLD, OVERLAP, SHARD_ITEMS, BLOCK = 0.5, 0.8, 20_000, 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
FILTER, SHORT = 1 << 20, 512


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word and the words before each text."""
    start, end = runs(WORD[data], off)
    return strings(data, start, end), np.searchsorted(start, off)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct fingerprints of k-word shingles; shorter word lists are one shingle of what there is."""
    if not len(words):
        return np.zeros(0, U64)
    return np.unique(windows(words, min(k, len(words))))


def length_class(n: int) -> int:
    """0 for items of up to `SHORT` words, then one more for each doubling."""
    return max(0, (n - 1) // SHORT).bit_length()


class Statistics:
    """What scores need to know of all items, whatever their shard."""

    def __init__(self, items: Iterable[tuple[object, str]]):
        self.n, self.df, self.longest = 0, Counter(), Counter()
        total = 0
        for _, text in items:
            words = words_of(text or "")
            if len(words):
                self.n, total, kind = self.n + 1, total + len(words), length_class(len(words))
                self.longest[kind] = max(self.longest[kind], len(words))
                self.df.update(np.unique(words).tolist())
        self.mean = total / self.n if self.n else 1


class Index:
    """Posting lists of normalised impacts, in blocks with their largest impact."""

    def __init__(self, items: Sequence[tuple[object, str]], k1: float = K1, b: float = B, shingle: int = SHINGLE, threshold: float = THRESHOLD, stats: Statistics | None = None):
        stats = stats or Statistics(items)
        self.ids, self.threshold, self.shingle, self.parts = [], threshold, shingle, []
        bags = []
        for item, text in items:
            words = words_of(text or "")
            if not len(words):
                continue
            lines = [x for x in text.split("\n") if x.strip()]
            question, answer = ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (text, text)
            self.ids.append(item)
            bags.append(Counter(words.tolist()))
            self.parts.append(tuple((len(words_of(p)), shingles(words_of(p), shingle)) for p in (question, answer, text)))
        n, df, mean = stats.n, stats.df, stats.mean
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, bag in enumerate(bags):
            norm = k1 * (1 - b + b * sum(bag.values()) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + norm) for t, f in bag.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((i, x / own))
        terms = sorted(postings)
        self.terms = np.array(terms, U64)
        self.items = [np.array([i for i, _ in postings[t]], np.int64) for t in terms]
        self.impacts = [np.array([x for _, x in postings[t]]) for t in terms]
        self.most = np.array([x.max() for x in self.impacts]) if terms else np.zeros(0)
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        order = np.argsort(self.most)
        self.low = np.zeros(FILTER, bool)
        self.low[(self.terms & U64(FILTER - 1)).astype(np.int64)] = True
        # essential: outside the longest prefix by impact whose sum stays below half the threshold
        self.essential = np.ones(len(terms), bool)
        self.essential[order[: int(np.searchsorted(np.cumsum(self.most[order]), threshold / 2))]] = False
        # the longest of all items of these items' length, so that passages do not depend on shards
        self.longest = max([stats.longest[length_class(sum(bag.values()))] for bag in bags], default=1)
        self.flat_at = np.concatenate([[0], np.cumsum([len(x) for x in self.items])]).astype(np.int64)
        self.flat_items = np.concatenate(self.items) if terms else np.zeros(0, np.int64)
        self.flat_impacts = np.concatenate(self.impacts) if terms else np.zeros(0)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and their terms."""
        maybe = np.flatnonzero(self.low[(words & U64(FILTER - 1)).astype(np.int64)])
        at = np.searchsorted(self.terms, words[maybe])
        at[at == len(self.terms)] = 0
        ok = self.terms[at] == words[maybe]
        return maybe[ok], at[ok]

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages in which some item may reach the threshold. Pairs (passage, term) are distinct."""
        weak = ~self.essential[term]
        n = int(passage.max()) + 1 if len(passage) else 0
        rest = np.bincount(passage[weak], self.most[term[weak]], n)
        p, t = passage[~weak], term[~weak]
        size = self.flat_at[t + 1] - self.flat_at[t]
        bound = rest + np.bincount(p, self.most[t], n)
        open_ = bound[p] >= self.threshold - 1e-9
        p, t, size = p[open_], t[open_], size[open_]
        if not len(p):
            return np.flatnonzero(rest >= self.threshold - 1e-9)
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(self.flat_at[t], size)
        key = np.repeat(p, size) * len(self.ids) + self.flat_items[at]
        keys, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, self.flat_impacts[at])
        owner_ = keys // len(self.ids)
        return np.unique(np.concatenate([owner_[total + rest[owner_] >= self.threshold - 1e-9], np.flatnonzero(rest >= self.threshold - 1e-9)]))

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items whose score for the passage reaches the threshold, by block-max WAND."""
        lists = [[int(self.items[t][0]), 0, int(t)] for t in terms.tolist()]  # current item, place, term
        threshold, out = self.threshold - 1e-9, []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            blocks, last = 0.0, 1 << 60
            for i in range(pivot + 1):
                _, place, t = lists[i]
                k = (place + int(np.searchsorted(self.items[t][place:], item))) // BLOCK
                if k < len(self.block_most[t]):
                    blocks += self.block_most[t][k]
                    last = min(last, int(self.items[t][min((k + 1) * BLOCK, len(self.items[t])) - 1]))
            if blocks < threshold:
                # no item up to the nearest block end can reach it, nor before the next list's item
                to = max(item + 1, min(last + 1, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 60)) if last < 1 << 60 else item + 1
            elif lists[0][0] == item:
                score = sum(float(self.impacts[t][place]) for _, place, t in lists[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            moved = []
            for i, (here, place, t) in enumerate(lists):
                if i <= pivot and here < to:
                    place += int(np.searchsorted(self.items[t][place:], to))
                    if place >= len(self.items[t]):
                        continue
                    here = int(self.items[t][place])
                moved.append([here, place, t])
            lists = moved
        return out


def search(index: Index, words: np.ndarray, at: np.ndarray, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """Yields (text, item, score, question overlap, answer overlap) for verified items of a piece of texts; the best passage of each pair."""
    place, term = index.lookup(words)
    if not len(place):
        return
    half = max(32, index.longest)
    text = owner(at, place)
    chunk = (place - at[text]) // half
    # passages are 2 * half words long and begin every half words; number them through all texts
    first = np.concatenate([[0], np.cumsum((np.diff(at) + half - 1) // half)])
    own = first[text] + chunk
    passage = np.concatenate([own, (own - 1)[chunk > 0]])
    pairs = np.unique(passage * len(index.terms) + np.concatenate([term, term[chunk > 0]]))
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in index.candidates(passage, term).tolist():
        lo, hi = np.searchsorted(passage, [p, p + 1])
        found = index.wand(term[lo:hi])
        if not found:
            continue
        t = int(np.searchsorted(first, p, "right")) - 1
        a = at[t] + (p - first[t]) * half
        mine = words[a : min(a + 2 * half, at[t + 1])]
        grams: dict[int, np.ndarray] = {}

        def share(part: tuple[int, np.ndarray]) -> float:
            k = min(index.shingle, part[0])
            if k not in grams:
                grams[k] = shingles(mine, k)
            return len(np.intersect1d(grams[k], part[1], assume_unique=True)) / len(part[1]) if len(part[1]) else 0.0

        for item, score in found:
            question, answer, whole = (share(x) for x in index.parts[item])
            if (min(question, answer) >= overlap or whole >= overlap and answer > 0) and score > best.get((t, item), (0.0,))[0]:
                best[t, item] = score, question, answer
    for (t, item), (score, question, answer) in sorted(best.items()):
        yield t, item, score, question, answer


def apply(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    out = None
    for made in _indexes(items, shard_items, threshold):
        index = spark.sparkContext.broadcast(made)

        def match(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            found = index.value
            for batch in batches:
                ids, got = batch.column(0).to_pylist(), []
                for lo, _, data, off in pieces(pc.utf8_lower(batch.column(1))):
                    words, at = tokens(data, off)
                    got += [(ids[lo + t], one.ids[i], s, q, a) for one in found for t, i, s, q, a in search(one, words, at, overlap)]
                columns = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], _arrow(item_kind)), *(pa.array(c, pa.float64()) for c in columns[2:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def _indexes(items: DataFrame, shard_items: int, threshold: float) -> Iterator[list[Index]]:
    rows = items.select("item_id", "text")
    stats = Statistics(rows.toLocalIterator())
    for shard in _shards(rows.toLocalIterator(), shard_items):
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for item, text in shard:
            by_length[length_class(len(words_of(text or "")))].append((item, text))
        yield [Index(alike, threshold=threshold, stats=stats) for _, alike in sorted(by_length.items())]


def _shards(rows: Iterator, size: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for r in rows:
        held.append((r.item_id, r.text))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The documents without the contaminated ones, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    for made in _indexes(items, shard_items, threshold):
        index = spark.sparkContext.broadcast(made)

        def drop(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_col))
                for lo, hi, data, off in pieces(pc.utf8_lower(texts)):
                    good = np.ones(hi - lo, bool)
                    words, at = tokens(data, off)
                    good[[t for one in index.value for t, *_ in search(one, words, at, overlap)]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(good))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs
