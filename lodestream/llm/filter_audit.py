"""Filter interaction audit: what each of five filters removes, alone and in every order.

Words are exploded, counted per (text, word) and then per text for totals and distinct words; the
flags that need no words, the copies and the labels are outer-joined to that, and one aggregation
per part of the corpus keeps a conditional count for each of the 32 sets of failed filters. Every
order of filters, overlap and Shapley value follows from these counts.

A text's words do not depend on its row, so copies are merged first, in every task before anything
moves: texts are shuffled once, by their key (120 bits of SHA-256), and what follows needs no further exchange for
words. Rows travel as (id, key, part). No group grows with the number of copies of a text, of
repeated rows or of rows without an id.

Defined results: a null text is an empty one and has no words; a null part is the empty string; a
row without an id is never a copy of a smaller id and has no labels; repeated rows of one id count
each and are no copies of each other; of repeated labels the largest counts; null labels are no
labels; columns that are not named in the call are not read, whatever they are called; an empty
table gives no rows. Very long texts are exploded like others and aggregated with spilling.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the filters, in the order of the bits of a set of failed filters.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3


#: Columns that stand for a text. Numbers make the words' aggregation a third cheaper than a digest in binary.
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """Adds the key of the whole text: 120 bits of its SHA-256 as two numbers."""
    found = docs.select(*columns, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_sha"))
    return found.withColumns({k: F.conv(F.substring("_sha", 1 + 15 * i, 15), 16, 10).cast("long") for i, k in enumerate(KEY)}).drop("_sha")


def text_flags(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, failed): the set of filters A to D, as bits, that each distinct text fails."""
    texts = _keyed(docs, text, F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy(*KEY).agg(F.first("text").alias("text"))
    # white space at a text's ends makes an empty word, which the totals leave out: a filter would split the text twice
    words = texts.select(*KEY, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    totals = words.groupBy(*KEY).agg(F.sum(F.when(real, F.col("n"))).alias("n_words"), F.count(F.when(real, 1)).alias("n_distinct"))
    upper, symbols = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_UPPER * F.char_length("text"), F.col("text").rlike("[#$%&*|]")
    n_words, n_distinct = (F.coalesce(c, F.lit(0)) for c in ("n_words", "n_distinct"))
    failed = (n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT * n_words, F.col("upper"), F.col("symbols"))
    told = texts.select(*KEY, upper.alias("upper"), symbols.alias("symbols")).join(totals, KEY, "left")
    return told.select(*KEY, sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(failed)), F.lit(0)).alias("failed"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic to (id, k1, k2, part, n). Rows without an id are spread by a number that no label has."""
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    spread = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64(*KEY), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    found = rows.withColumns({"_id": F.coalesce("id", F.lit(0)), "_spread": spread}).join(told.withColumn("_spread", F.lit(0).cast("long")), ["_id", "_spread"], "left")
    return found.select("id", *KEY, "part", "n", *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("good", "toxic")))


def groups(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(k1, k2, part, good, toxic, copies, firsts): rows of a text that have a smaller id of that text, and rows that have none."""
    rows = _keyed(docs, text, F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    rows = _labelled(rows.groupBy("id", *KEY, "part").agg(F.count("*").alias("n")), labels)
    known = F.col("id").isNotNull()
    told = rows.groupBy(*KEY, "part", "good", "toxic").agg(F.min(F.when(known, F.struct("id", "n"))).alias("least"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_id"), F.sum("n").alias("n"))
    at_first = F.when(F.col("least.id") == F.min("least.id").over(Window.partitionBy(*KEY)), F.col("least.n")).otherwise(F.lit(0))
    return told.withColumn("copies", F.col("with_id") - at_first).select(*KEY, "part", "good", "toxic", "copies", (F.col("n") - F.col("copies")).alias("firsts"))


def failure_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, n_0 .. n_31, good_0 .., toxic_0 ..): rows per set of failed filters, all and by label. One row per part."""
    found = groups(docs, labels, doc_id, text, part).join(text_flags(docs, text), KEY, "left")
    copied = 1 << FILTERS.index("E")

    def count(bits: int, among: Column | None) -> Column:
        hit = F.col("failed") == bits % copied if among is None else (F.col("failed") == bits % copied) & among
        return F.coalesce(F.sum(F.when(hit, F.col("copies" if bits & copied else "firsts"))), F.lit(0))

    kinds = {"n": None, "good": F.col("good"), "toxic": F.col("toxic")}
    return found.groupBy("part").agg(*(count(bits, among).alias(f"{k}_{bits}") for k, among in kinds.items() for bits in range(2 ** len(FILTERS))))


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, from the counts alone."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    kinds = ("n", "good", "toxic")
    arrays = counts.select("part", *(F.array(*(f"{k}_{s}" for s in range(2 ** len(FILTERS)))).alias(k) for k in kinds))
    steps = arrays.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [(1 << i, F.instr("filter_order", x)) for i, x in enumerate(FILTERS)]
    sets = {"mine": lambda place: place == F.col("step"), "before": lambda place: place < F.col("step")}
    steps = steps.withColumns({name: sum((F.when(chosen(place), F.lit(bit)).otherwise(F.lit(0)) for bit, place in at), F.lit(0)) for name, chosen in sets.items()})

    def total(kind: str, value: Callable[[Column, Column], Column]) -> Column:
        """The sum over all sets of failed filters; `value` gets a set and its count."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)), F.lit(0).cast("long"), lambda done, s: done + value(s, F.element_at(kind, s + 1)))

    def rows(kind: str, chosen: Callable[[Column], Column]) -> Column:
        return total(kind, lambda s, n: F.when(chosen(s), n).otherwise(F.lit(0).cast("long")))

    mine, before = F.col("mine"), F.col("before")
    here = lambda s: (s.bitwiseAND(mine) != 0) & (s.bitwiseAND(before) == 0)
    # a row that k filters fail is removed by each of them in one k-th of the orders
    shares = F.array(*(F.lit(0 if k == 0 else factorial(len(FILTERS)) // k) for k in range(len(FILTERS) + 1)))
    return steps.select(
        "part", "filter_order", "step",
        rows("n", lambda s: s.bitwiseAND(mine.bitwiseOR(before)) == 0).alias("kept"),
        rows("n", here).alias("removed"),
        rows("n", lambda s: (s.bitwiseAND(mine) != 0) & (s.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at("n", mine + 1).alias("unique_fails"),
        rows("good", here).alias("good_lost"),
        rows("toxic", here).alias("toxic_lost"),
        total("n", lambda s, n: F.when(s.bitwiseAND(mine) != 0, n * F.element_at(shares, F.bit_count(s) + 1)).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(failure_counts(docs, labels))
