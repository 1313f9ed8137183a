"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text (shares of symbols, capitals, repeated words and so on) are
standardised, mapped to cosines of random projections, which approximate a Gaussian kernel, and
scored by a ridge regression. Its normal equations are summed per partition, then per group of
partitions, so the driver gets a handful of fixed-size matrices. A fold of the training rows, kept
out of the regression, gives a histogram of raw scores; pooling adjacent violators over its bins
gives the calibrated score.

The fit takes at most `max_labels` labelled rows, drawn by a hash of their id: so many ids can be
broadcast, and only their texts are measured twice. Every row is scored.

Rows whose crc32(id as text) is a multiple of 5 are held out: their labels are never read. The
statistics see the text alone, never the id, the labels or other columns.

Null and empty texts are scored like any other, from their statistics (all zero). Repeated rows
get equal scores; labels that repeat an id all count. Without usable labels of both kinds every
score is 0.5. An empty table gives an empty result; other columns are ignored, whatever their names.
A null id is never held out. A text of any length is measured whole, by one worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import Measured, per_text
from .tables import bounded, keep, tidy
from .textblock import pieces

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "bars", "shouts", "line_words", "distinct", "other", "spaces")
N_COSINES, WIDTH, RIDGE, BINS, GROUPS, CUT, SEED, MAX_LABELS = 128, 3.0, 1.0, 512, 8, 0.3, 11, 50_000


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a piece."""
    m = Measured(data, off)
    c = {k: v.astype(np.float64) for k, v in per_text(m).items()}
    words, chars, lines, letters = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines", "n_letters"))
    return np.stack(
        [
            np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 40), c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
            c["n_stops"] / words, c["n_bars"] / words, c["n_shouts"] / words, np.log1p(c["n_words"] / lines), c["n_distinct"] / words, 1 - c["n_letters"] / np.maximum(c["word_chars"], 1), (c["n_chars"] - c["word_chars"]) / words,
        ],
        1,
    )


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def drawn(labels: DataFrame, max_labels: int) -> DataFrame:
    """(id, quality) of the usable labels outside the held-out fold; of more than `max_labels`, those of the smallest hashes of the id."""
    known = labels.select(labels["doc_id"].alias("label_id"), labels["quality"].cast("int").alias("quality"), fold(labels["doc_id"]).cast("int").alias("fold")).where("quality in (0, 1) and fold != 0")
    n = known.count()
    if n > max_labels:  # a border a little below the bound, since hashes spread by chance
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) < int((1 << 40) * 0.95 * max_labels / n))
    return known


def statistics(rows: DataFrame) -> DataFrame:
    """(fold, quality, x) of labelled rows (text, fold, quality)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(0)):
                x = features(data, off)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), values], names=["fold", "quality", "x"])
        tidy()

    return rows.select("text", "fold", "quality").mapInArrow(measure, "fold int, quality int, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


class Cosines:
    """Standardised statistics, cosines of random projections of them, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1)
        self.w, self.b = r.normal(0, 1 / width, (len(mean), n)), r.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / len(self.mean), np.ones((len(x), 1))], 1)


def pool(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to `mean` with these weights."""
    blocks: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def _normal_equations(train: DataFrame, cosines: Cosines) -> tuple[np.ndarray, np.ndarray]:
    width = len(cosines.b) + len(FEATURES) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group = np.zeros((width, width + 1)), TaskContext.get().partitionId() % GROUPS
        for batch in batches:
            if batch.num_rows:
                phi, y = cosines(matrix(batch.column("x"))), batch.column("quality").to_numpy().astype(float)
                gram += phi.T @ np.concatenate([phi, (2 * y - 1)[:, None]], 1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "sums": pa.array([gram.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"sums": pa.array([sums.tobytes()], pa.binary())})

    parts = train.mapInArrow(part, "part long, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
    both = sum((np.frombuffer(r.sums) for r in parts), np.zeros(width * (width + 1))).reshape(width, width + 1)
    return both[:, :-1], both[:, -1]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labels: int, n_cosines: int = N_COSINES, width: float = WIDTH, ridge: float = RIDGE) -> Scoring:
    known = drawn(labels, max_labels)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    return _fit(keep(statistics(rows), "train"), n_cosines, width, ridge)


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_cosines: int = N_COSINES, width: float = WIDTH, ridge: float = RIDGE, cut: float = CUT, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    bounded(docs.sparkSession)
    scoring = fitted(docs, labels, id_col, text_col, max_labels, n_cosines, width, ridge)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scoring(features(data, off)))], names=["doc_id", "score"])
        tidy()

    scored = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, max_labels: int = MAX_LABELS) -> DataFrame:
    """The documents predicted good, with all their columns."""
    bounded(docs.sparkSession)
    scoring = fitted(docs, labels, id_col, text_col, max_labels)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            for lo, hi, data, off in pieces(texts):
                yield batch.slice(lo, hi - lo).filter(pa.array(scoring(features(data, off)) >= cut))
        tidy()

    return docs.mapInArrow(select, docs.schema)


class Scoring:
    """Raw ridge scores and their calibration. Without a fit, 0.5."""

    def __init__(self, cosines: Cosines | None, beta: np.ndarray | None):
        self.cosines, self.beta, self.at, self.to = cosines, beta, None, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.cosines(x) @ self.beta + 1) / 2, 0, 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        if self.at is None:
            return raw
        return np.clip(0.98 * np.interp(raw, self.at, self.to) + 0.02 * raw, 0, 1)


def _fit(train: DataFrame, n_cosines: int, width: float, ridge: float) -> Scoring:
    fit_rows = train.where("fold != 4")
    moments = fit_rows.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(FEATURES)) for n, f in (("m", F.mean), ("s", F.stddev_pop))], F.min("quality").alias("lo"), F.max("quality").alias("hi")).first()
    if moments.lo is None or moments.lo == moments.hi:
        return Scoring(None, None)
    mean, scale = (np.array([moments[f"{n}{i}"] for i in range(len(FEATURES))]) for n in "ms")
    cosines = Cosines(mean, scale, n_cosines, width, SEED)
    gram, right = _normal_equations(fit_rows, cosines)
    scoring = Scoring(cosines, np.linalg.solve(gram + ridge * np.eye(len(gram)), right))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.minimum((scoring.raw(matrix(batch.column("x"))) * BINS).astype(int), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column("quality")], names=["bin", "quality"])

    bins = sorted(train.where("fold = 4").mapInArrow(raw, "bin long, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).collect())
    if bins:
        n, good = (np.array([r[k] for r in bins], float) for k in ("n", "good"))
        scoring.at, scoring.to = (np.array([r.bin for r in bins]) + 0.5) / BINS, pool(n, good / n)
    return scoring
