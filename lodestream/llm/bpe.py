"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Word counts over the whole corpus choose the `max_words` most frequent words; their ids are merged
once and compiled into a transducer (`lexicon`), which Spark hands to every executor as a file and
each worker memory-maps. Other words are merged exactly, by the vocabulary's merge ranks. A bounded
memo holds what a worker saw last.

The vocabulary file is a parameter. It describes a word-level BPE: Unicode composition, lower
case, white space dropped, `</w>` ends a word, no decoder (tokens are joined by a space). Texts
with unusual characters or with special tokens are normalised and cut by the tokenizers library
itself; for plain ones, an equivalent cut by white space and one pattern is much faster.

Null and empty texts have no tokens. A word of any length is merged in n log n steps, and a text of
any length is encoded whole, by one worker. Repeated rows are encoded each for themselves. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, build
from .tables import bounded, keep, shared_dir, tidy

MAX_WORDS, MEMO, FLUSH, LONG = 1 << 16, 150_000, 300_000, 64
#: Characters for which Unicode composition changes nothing and lower case is one character.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s\xa0{_LETTER}{_NUMBER}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """Merge ranks and tokens of one vocabulary file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        read = json.loads(spec)
        model = read["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # a merge in numbers: ids of the pair in one key, its rank and the id of the result
        self.merges = {self.ids[a] << 20 | self.ids[b]: (i << 20) + self.ids[a + b] for i, (a, b) in enumerate(pairs) if a in self.ids and b in self.ids and a + b in self.ids}
        self.none = 1 << 60
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.library = Tokenizer.from_str(spec)

    def merge(self, word: str) -> list[int]:
        """Merges a byte-level word: always the pair of the lowest rank, leftmost first."""
        ids = self.ids
        parts = [ids[c] for c in word[:-1] if c in ids]
        if (last := word[-1] + self.end) in ids:
            parts.append(ids[last])
        if len(parts) > LONG:
            return self._merge_long(parts)
        get, none = self.merges.get, self.none
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of pairs, in n log n steps; parts that were merged away are -1."""
        get, n = self.merges.get, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = m & 0xFFFFF, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (m := get(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (m, i, parts[i], parts[k]))
            h = left[i]
            if h >= 0 and (m := get(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (m, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def bytes_of(self, piece: str) -> str:
        """A piece in byte letters."""
        if piece.isascii() and piece.isprintable():
            return piece
        letters = self.letters
        return "".join([letters[b] for b in piece.encode()])


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and "<|" not in text


class Encoder(dict):
    """Memo from a chunk without white space to (ids as text, tokens as text)."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, memo: int = MEMO):
        super().__init__()
        self.vocabulary, self.lexicon, self.memo, self.old = vocabulary, lexicon, memo, {}

    def word(self, word: str) -> list[int]:
        """Ids of a byte-level word: from the lexicon, or merged."""
        found = self.lexicon.get(word.encode()) if self.lexicon else None
        return self.vocabulary.merge(word) if found is None else found

    def __missing__(self, chunk: str) -> tuple[str, str]:
        if len(self) >= self.memo:  # what was not asked for since the last change of generations goes
            self.old = dict(self)
            self.clear()
        value = self.old.get(chunk)
        if value is not None:
            self[chunk] = value
            return value
        v = self.vocabulary
        ids = [i for piece in PIECE.findall(chunk) for i in self.word(v.bytes_of(piece))]
        value = " ".join(map(str, ids)), " ".join([v.tokens[i] for i in ids])
        if len(chunk) < 64:
            self[chunk] = value
        return value

    def forget(self) -> None:
        """Empties the memo, so that a reused worker holds no more than the vocabulary and the lexicon."""
        self.clear()
        self.old = {}

    def encode(self, text: str) -> tuple[str, str]:
        """Ids and tokens of a text, joined by spaces."""
        if plain(text):
            parts = list(map(self.__getitem__, text.lower().split()))
            if not parts:
                return "", ""
            return " ".join([a for a, _ in parts if a]), " ".join([b for _, b in parts if b])
        ids = self.ids(text)
        return " ".join(map(str, ids)), " ".join([self.vocabulary.tokens[i] for i in ids])

    def ids(self, text: str) -> list[int]:
        v, out = self.vocabulary, []
        for i, part in enumerate(v.cut.split(text) if v.cut else [text]):
            if i % 2:
                out.append(v.special[part])
            elif part:
                cut = v.library.pre_tokenizer.pre_tokenize_str(v.library.normalizer.normalize_str(part))
                out += [i for piece, _ in cut for i in self.word(piece)]
        return out


def words_of(vocabulary: Vocabulary, texts: Counter) -> Counter:
    """Byte-level words of counted chunks."""
    out: Counter = Counter()
    for chunk, n in texts.items():
        for piece in PIECE.findall(chunk):
            out[piece] += n
    return out


def frequent(rows: DataFrame, max_words: int) -> list[str]:
    """The most frequent words of all plain texts, at most `max_words`; words of about the same count are all in or all out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = words_of(None, held)
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text and plain(text):
                    held.update(text.lower().split())
                    if len(held) >= FLUSH:
                        yield out()
        if held:
            yield out()
        tidy()

    counted = keep(rows.select("text").mapInArrow(count, "word string, n long").where(F.length("word") < 64).groupBy("word").agg(F.sum("n").alias("n")), "words")
    # classes of counts, so that the driver sees a bounded histogram and then only the words it takes
    step = F.floor(F.log2("n") * 64).cast("long")
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        held += r.words
        if held > max_words:
            break
        least = r.step
    return [] if least is None else [r.word for r in counted.where(step >= least).select("word").collect()]


def compiled(vocabulary: Vocabulary, words: list[str]) -> bytes:
    keyed = sorted((w.encode(), w) for w in map(vocabulary.bytes_of, words))
    return build([k for k, _ in keyed], [vocabulary.merge(w) for _, w in keyed])


def handed_out(spark, raw: bytes) -> str:
    """Writes the lexicon to the shared folder and lets Spark bring it to every executor; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = fs.create(path, True)
    stream.write(raw)
    stream.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


_open: dict[str, Encoder] = {}


def opened(name: str, spec: str) -> Encoder:
    """This worker's encoder; one is kept between tasks."""
    if name not in _open:
        _open.clear()
        _open[name] = Encoder(Vocabulary(spec), Lexicon(SparkFiles.get(name)))
    return _open[name]


def apply(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded. `spec` is the vocabulary file's content."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    name = handed_out(spark, compiled(Vocabulary(spec), frequent(rows, max_words)))
    shared = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(name, shared.value)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in batch.column(1):
                ids, tokens = encoder.encode(text.as_py() or "")
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(sha(ids))
                out["decoded_sha256"].append(sha(tokens))
                if with_ids:
                    out["ids"].append([int(i) for i in ids.split()])
                    out["decoded"].append(tokens)
            columns = [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            if with_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], *(["ids", "decoded"] if with_ids else [])])
        encoder.forget()
        tidy()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
