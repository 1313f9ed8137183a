"""Line-first quality rules.

Every line with words is judged first: navigation bars, symbol noise, shouting, fragments without
an end mark, boilerplate phrases and repeats of an earlier line fail. Failing lines are removed; a
text is rejected when the lines that stay hold less than `min_kept` of its words. The base rules
(too few words, too many words in 5-word windows that recur) are applied on the whole text.

Null and empty texts have no words and fail the base rule. Repeated rows and ties are judged each
on its own text; a text of any length is judged whole, by one worker. Repeats are compared byte by
byte, fingerprints only propose them. An empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stats import Measured, failing_lines, per_text
from .tables import bounded, tidy
from .textblock import pieces

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_KEPT = 10, 20, 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept: float = MIN_KEPT, with_text: bool = False) -> DataFrame:
    """One row per text: base counts, base_failed, kept, n_lines_removed, n_words_removed and, if asked for, the cleaned text. Only maps: no shuffle."""
    bounded(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1)):
                yield _judged(batch.column(0).slice(lo, hi - lo), data, off, min_kept, with_text)
        tidy()

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"
    return docs.mapInArrow(judge, schema + (", cleaned string" if with_text else ""))


def _judged(ids: pa.Array, data: np.ndarray, off: np.ndarray, min_kept: float, with_text: bool) -> pa.RecordBatch:
    n = len(ids)
    m = Measured(data, off)
    count, bad, doc = per_text(m), failing_lines(m) > 0, m.line_doc
    lost = np.bincount(doc[bad], m.line_words[bad], n).astype(np.int64)
    base = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
    kept = ~base & (count["n_words"] - lost >= min_kept * count["n_words"])
    columns = {"doc_id": ids} | {k: count[k] for k in BASE} | {"base_failed": base, "kept": kept, "n_lines_removed": np.bincount(doc[bad], minlength=n), "n_words_removed": lost}
    if with_text:
        raw = data.tobytes()
        parts: list[list[bytes]] = [[] for _ in range(n)]
        for d, a, b in zip(doc[~bad].tolist(), m.line_start[~bad].tolist(), m.line_end[~bad].tolist(), strict=True):
            parts[d].append(raw[a:b])
        columns["cleaned"] = pa.array([b"\n".join(x).decode() for x in parts], pa.string())
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
