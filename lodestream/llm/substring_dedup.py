"""Repeated-phrase automata: removes words of passages that occur earlier in the corpus.

A window is `window` consecutive words of one text. The words of every window that also starts
earlier (smaller id, or same text and earlier start) are removed.

1. Candidates. Each text's windows are represented by phrases of `phrase` words: the smallest
   fingerprint in each window, so equal windows choose equal phrases. Phrases that recur anywhere
   in the corpus are found by an exchange of fingerprints; the windows they represent are then
   compared over all blocks, and those that are not the first of their like are told where the
   first stands.
2. Confirmed passages. Runs of such windows are asked for where they stand first, and the words
   themselves come back: they are a block's shard of the repeated passages.
3. Each block compiles its shard into an Aho-Corasick automaton and streams all its texts through
   it. A passage's words go wherever the automaton finds them, except where it stands first. Only
   these hits remove words, so equality never rests on fingerprints.

The automata together hold each passage once per block that has it, so work and memory follow the
input, and no automaton outgrows its block's texts. Exact copies of a text are settled by a
128-bit key alone.

Null and empty texts have no words and lose none. A text of any length is one unit of work: it must
fit in a Python worker's memory some thirty times over. Rows that repeat an id and its text get the
same result; rows that share an id but not a text are ordered arbitrarily among themselves; a null
id counts as the smallest. An empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, WANT, Block, corpus, exchange, fetched, opened, text_key, told, unpack, wanted
from .tables import bounded, drop_kept, ends_shuffles, keep
from .textblock import SPACE, U64, Words, covered, found, member, repeated, runs, windows

WINDOW, PHRASE = 20, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width] for every i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def chosen(words: Words, hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the phrases that represent the windows: each window's smallest."""
    n, width = len(hashes), window - phrase + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at, fp = words.windows(hashes, phrase)
    every = np.full(n - phrase + 1, np.iinfo(np.uint64).max, U64)
    every[at] = fp
    least = slide(every, width, np.minimum)
    least[words.doc[: n - window + 1] != words.doc[window - 1 :]] = 0
    edge = np.zeros(width - 1, U64)
    most = slide(np.concatenate([edge, least, edge]), width, np.maximum)
    take = np.flatnonzero(most == every)
    take = take[every[take] > 0]
    return take, every[take]


def _emit_phrases(window: int, phrase: int):
    def emit(block: Block) -> Iterator[tuple[np.ndarray, dict]]:
        words = Words(block.data, block.off)
        fps = np.unique(chosen(words, words.hashes(), window, phrase)[1])
        none = np.zeros(len(fps), np.uint32)
        yield fps, {"place": none, "check": none}

    return emit


def doubtful(words: Words, hashes: np.ndarray, recurring: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows whose phrase recurs, their fingerprints, and second fingerprints."""
    at, fp = chosen(words, hashes, window, phrase)
    at = at[member(fp, recurring) | repeated(fp)]
    near = covered(len(words), np.maximum(at - (window - phrase), 0), window - phrase + 1)
    starts, full = words.windows(hashes, window)
    take = near[starts]
    starts = starts[take]
    second = (windows(hashes * U64(0x9E3779B97F4A7C15) + U64(1), window)[starts] >> U64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
    return starts, full[take], second


def _emit_windows(window: int, phrase: int):
    def emit(block: Block) -> Iterator[tuple[np.ndarray, dict]]:
        words = Words(block.data, block.off)
        starts, full, second = doubtful(words, words.hashes(), block.found, window, phrase)
        full, first = np.unique(full, return_index=True)
        yield full, {"doc": block.ids[words.doc[starts[first]]], "place": starts[first].astype(np.uint32), "check": second[first]}

    return emit


def late(block: Block, recurring: np.ndarray, window: int, phrase: int) -> pa.RecordBatch:
    """Requests for the passages of this block that stand earlier, here or elsewhere."""
    words = Words(block.data, block.off)
    starts, full, _ = doubtful(words, words.hashes(), recurring, window, phrase)
    _, first, like = np.unique(full, return_index=True, return_inverse=True)
    at = found(full, block.found)
    source = np.where(at >= 0, block.source[at] if len(block.source) else 0, block.number)
    place = np.where(at >= 0, block.place[at] if len(block.place) else 0, starts[first[like]] if len(first) else 0)
    other = (source != block.number) | (place != starts)
    out = wanted(block.number, starts[other], source[other], place[other], 1, 1)
    # runs of window starts so far; as many words as their windows cover. Where a text repeats itself, its runs ask for the same passage once
    here, source, place, n = (out.column(k).to_numpy() for k in (1, 2, 3, 4))
    _, once = np.unique(np.stack([source, place, n], 1), axis=0, return_index=True)
    columns = (np.full(len(once), block.number), here[once], source[once], place[once], n[once] + window - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "here", "source", "place", "n"])


def _passage(block: Block, place: int, n: int) -> tuple[int, bytes]:
    """The n words from word `place` on."""
    if "words" not in block.more:
        block.more["words"] = Words(block.data, block.off)
    words = block.more["words"]
    return 0, b" ".join(block.data[words.start[place] : words.end[place + n - 1]].tobytes().split())


def removed(joined: bytes, starts: np.ndarray, passages: dict[bytes, set[int]]) -> np.ndarray:
    """Which words the passages cover. `joined` has a space before and after each word, `starts` where each word begins; `passages` has for each the word numbers in this block, -1 elsewhere, where it stands first."""
    gone = np.zeros(len(starts), bool)
    if not passages:
        return gone
    automaton = ahocorasick.Automaton()
    for text, sources in passages.items():
        automaton.add_word(f" {text.decode('latin-1')} ", (len(text), text.count(b" ") + 1, sources))
    automaton.make_automaton()
    hits = [(end - size, n, sources) for end, (size, n, sources) in automaton.iter(joined.decode("latin-1"))]
    at = np.searchsorted(starts, [a for a, _, _ in hits]).tolist()
    ok = [(a, n) for a, (_, n, sources) in zip(at, hits, strict=True) if len(sources) > 1 or a not in sources]
    return covered(len(starts), np.array([a for a, _ in ok], np.int64), np.array([n for _, n in ok], np.int64)) if ok else gone


def _distinct(docs: DataFrame, id_col: str, text_col: str, window: int, phrase: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all rows, and for each distinct text: key, first (its smallest id) and what is left of it."""
    bounded(docs.sparkSession)
    held = corpus(docs, id_col, text_col)
    rate = 2 / (window - phrase + 2) / 5
    phrases = keep(exchange(held.blocks, held.n_blocks, _emit_phrases(window, phrase), held.n_bytes * rate), "phrases")
    both = told(held.blocks, phrases)
    first = keep(exchange(both, held.n_blocks, _emit_windows(window, phrase), held.n_bytes / 20, True, {"doc": np.int64}), "windows")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            told_of = block.more["phrases"].as_py() or []
            yield late(block, np.unique(np.concatenate([unpack(x["fps"]) for x in told_of])) if told_of else np.zeros(0, U64), window, phrase)

    wants = keep(told(held.blocks, first, phrases.select("block", F.col("found").alias("phrases"))).mapInArrow(ask, WANT), "wants")
    drop_kept(phrases, first)
    passages = keep(fetched(held.blocks, wants, _passage, "passages"), "passages")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            yield _cut(block, with_text)

    schema = "key binary, first long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return held.ids, told(held.blocks, passages).mapInArrow(cut, schema)


@ends_shuffles
def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (the words left, as they stand where nothing was removed)."""
    ids, done = _distinct(docs, id_col, text_col, window, phrase, with_text)
    out = ids.select("doc_id", "key").join(done, "key", "left")
    copy = ~F.coalesce("doc_id", F.lit(NO_ID)).eqNullSafe(F.col("first")) & (F.col("n_words") >= window)
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(NOTHING)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


@ends_shuffles
def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents with their repeated passages cut out and all other columns as they were; rows of which nothing is left go, rows without words stay."""
    _, done = _distinct(docs, id_col, text_col, window, phrase, True)
    done = done.where("n_words = 0 or n_removed < n_words").select("key", "first", "n_words", "kept_text")
    # the other columns travel in one struct, so that none of their names meets those of the result
    rest = docs.select(F.struct(docs[id_col].cast("long").alias("id"), F.isnull(docs[text_col]).alias("none"), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]).alias("row"), text_key(docs[text_col]).alias("own"))
    whole = rest.join(done, F.col("own") == F.col("key")).where((F.coalesce("row.id", F.lit(NO_ID)) == F.col("first")) | (F.col("n_words") < window))
    text = F.when(~F.col("row.none"), F.col("kept_text"))
    return whole.select(*[(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _cut(block: Block, with_text: bool) -> pa.RecordBatch:
    raw = block.data.tobytes()
    bounds = list(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True))
    texts = [b" ".join(raw[a:b].split()) for a, b in bounds]
    n_words = [t.count(b" ") + 1 if t else 0 for t in texts]
    joined = b" " + b" \n ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    starts = runs(~SPACE[data], np.array([0, len(data)]))[0]
    passages: dict[bytes, set[int]] = {}
    for x in block.more["passages"].as_py() or []:
        passages.setdefault(x["text"], set()).add(x["place"] if x["source"] == block.number else -1)
    gone = removed(joined, starts, passages)
    at = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    lost = np.concatenate([[0], np.cumsum(gone)])
    lost = lost[at[1:]] - lost[at[:-1]]
    shas, kept = [], []
    for i, (text, (a, b)) in enumerate(zip(texts, bounds, strict=True)):
        if lost[i]:
            text = b" ".join(w for w, f in zip(text.split(b" "), gone[at[i] : at[i + 1]].tolist(), strict=True) if not f)
        shas.append(hashlib.sha256(text).hexdigest())
        if with_text:
            kept.append(text if lost[i] else raw[a:b])
    columns = {"key": pa.array(block.keys, pa.binary()), "first": pa.array(block.ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
    if with_text:
        columns["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
    return pa.RecordBatch.from_pydict(columns)
