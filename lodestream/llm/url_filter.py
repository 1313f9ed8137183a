"""URL filter: rules first, then the ratio of two character language models.

Rules (host and path prefix, longest wins) judge a URL where one fits. The URLs they judge are also
the labelled examples of two variable-order Markov models of characters, one for accepted and one
for rejected URLs, smoothed by Witten-Bell interpolation down to the uniform distribution. For the
other URLs, the difference of the two log-likelihoods, divided by the length, is calibrated on
labelled URLs held out from the models, and the URL is allowed if its calibrated probability is at
least one half.

The models count every distinct labelled URL that is not held out, the curve takes every one that is:
nothing is drawn or capped. Counts stay a table, keyed by context and character, as long as the distinct
contexts; what a context says of a character is worked out once for all URLs that hold it, and a URL's
score is a sum over a join. The driver sees two numbers of the curve and their sums.
Repeated URLs count once in the fit, so a host with a third of all rows has no more say than its
distinct URLs give it.

Null URLs and URLs without `://` have an empty host and path, fit no rule and are judged by the
models as an empty string, whose score is 0. An empty table gives an empty result; other columns
are ignored. Without examples of both verdicts every URL that no rule fits is allowed.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded, keep

#: (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER, MEMO, FLUSH = 5, 200_000, 200_000
#: Scores are summed as whole numbers of this unit, so that their order does not matter.
UNIT = 1 << 34
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the whole URL after `://` with the host in lower case."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_replace(rest, "^[^/?#]*", ""))


def fits(host: Column, path: Column, rule: str) -> Column:
    domain, _, prefix = rule.partition("/")
    return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{prefix}")


class Markov:
    """Counts of characters after contexts of 0 to `order` characters."""

    def __init__(self, texts: Sequence[str], order: int):
        self.order = order
        counts: dict[str, Counter] = defaultdict(Counter)
        for text in texts:
            text = "\x02" + text + "\x03"
            for i in range(1, len(text)):
                for k in range(min(order, i) + 1):
                    counts[text[i - k : i]][text[i]] += 1
        self.counts = {c: (dict(n), sum(n.values()), len(n)) for c, n in counts.items()}

    def logp(self, context: str, char: str) -> float:
        p = 1 / 257
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :])
            if seen is None:
                break
            n, total, kinds = seen
            p = (n.get(char, 0) + kinds * p) / (total + kinds)
        return math.log(p)


class Ratio:
    """Length-normalised log-likelihood difference, accepted minus rejected. Characters in equal contexts are looked up in a bounded memo."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected, self.memo = accepted, rejected, {}

    def __call__(self, text: str) -> float:
        if not text:
            return 0.0
        order, total, text, memo = self.accepted.order, 0.0, "\x02" + text + "\x03", self.memo
        for i in range(1, len(text)):
            key = text[max(0, i - order) : i + 1]
            value = memo.get(key)
            if value is None:
                if len(memo) >= MEMO:
                    memo.clear()
                value = memo[key] = self.accepted.logp(key[:-1], key[-1]) - self.rejected.logp(key[:-1], key[-1])
            total += value
        return total / (len(text) - 1)


def newton(sums: Callable[[float, float], Sequence[float]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a small ridge, from weighted sums of (g - p) s, g - p, q s s, q s and q at a curve."""
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = sums(a, b)
        ga, haa, hbb = ga - 1e-3 * a, haa + 1e-3, hbb + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def calibrate(scores: Sequence[float], good: Sequence[bool]) -> tuple[float, float]:
    """The curve of a few scores, both verdicts with the same weight."""
    n_good = sum(good)
    if not n_good or n_good == len(good):
        return 1.0, 0.0
    weights = [0.5 / n_good if g else 0.5 / (len(good) - n_good) for g in good]

    def sums(a: float, b: float) -> list[float]:
        out = [0.0] * 5
        for s, g, w in zip(scores, good, weights, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * s + b))))
            q = w * p * (1 - p)
            out = [x + y for x, y in zip(out, (w * (g - p) * s, w * (g - p), q * s * s, q * s, q), strict=True)]
        return out

    return newton(sums)


def chance(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score * a + b))))


def calibrated(held: DataFrame) -> tuple[float, float]:
    """The curve of a table (good, score): Spark sums it up for each step."""
    n = {r.good: r["count"] for r in held.groupBy("good").count().collect()}
    if len(n) < 2:
        return 1.0, 0.0

    def sums(a: float, b: float) -> list[float]:
        p, w = chance(F.col("score"), a, b), F.when(F.col("good"), 0.5 / n[True]).otherwise(0.5 / n[False])
        rest, q, s = w * (F.col("good").cast("double") - p), w * p * (1 - p), F.col("score")
        return list(held.agg(*[F.sum(x) for x in (rest * s, rest, q * s * s, q * s, q)]).first())

    return newton(sums)


def fit(rows: Sequence[tuple[str, bool, bool]], order: int = ORDER) -> tuple[Ratio, float, float] | None:
    """From a few (text, accepted, kept for calibration), in memory."""
    rows = sorted(rows)
    good, bad = ([t for t, g, held in rows if g == want and not held] for want in (True, False))
    if not good or not bad:
        return None
    ratio = Ratio(Markov(good, order), Markov(bad, order))
    held = [(ratio(t), g) for t, g, h in rows if h]
    return ratio, *calibrate([s for s, _ in held], [g for _, g in held])


def _counted(rows: DataFrame, schema: str, keys: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """Keys of every row with their number, added up in tasks as far as `FLUSH` keys go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in held.items()), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.update(keys(row))
                if len(held) >= FLUSH:
                    yield out()
        if held:
            yield out()

    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def counts_of(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """From (good, text): how often a character follows a context of 0 to `order` characters in texts of each verdict, and how often and by how many kinds a context is followed."""

    def keys(row: tuple) -> Iterator[tuple]:
        good, text = row[0], "\x02" + row[1] + "\x03"
        return ((good, text[i - k : i], text[i]) for i in range(1, len(text)) for k in range(min(order, i) + 1))

    found = _counted(labelled.select("good", "text"), "good boolean, context string, char string, n long", keys)
    of = lambda good: F.sum(F.when(F.col("good") == good, F.col("n")).otherwise(0))
    pairs = keep(found.groupBy("context", "char").agg(of(True).alias("n_good"), of(False).alias("n_bad")), "url_counts")
    kinds = [F.count_if(F.col(f"n_{v}") > 0).alias(f"kinds_{v}") for v in ("good", "bad")]
    return pairs, pairs.groupBy("context").agg(*[F.sum(f"n_{v}").alias(f"all_{v}") for v in ("good", "bad")], *kinds)


def scores(texts: DataFrame, labelled: DataFrame, order: int) -> DataFrame:
    """(id, score) of (id, text): the log-likelihood difference per character, accepted minus rejected. The empty text has no row."""
    pairs, contexts = counts_of(labelled, order)

    def keys(row: tuple) -> Iterator[tuple]:
        text = "\x02" + row[1] + "\x03"
        return ((row[0], text[max(0, i - order) : i], text[i]) for i in range(1, len(text)))

    placed = keep(_counted(texts.where("text <> ''"), "id long, context string, char string, n long", keys), "url_keys")
    # a key's contexts by length; each pair of a context and a character is looked up once, so no context is a hot key
    asked = placed.select("context", "char").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.length("context"))))
    asked = asked.select(F.col("context").alias("full"), "char", "k", F.expr("right(context, k)").alias("context"))
    known = asked.select("context", "char").distinct().join(contexts, "context").join(pairs, ["context", "char"], "left").na.fill(0)
    steps = asked.join(known, ["context", "char"]).groupBy("full", "char").agg(F.array_sort(F.collect_list(F.struct("k", *[f"{x}_{v}" for v in ("good", "bad") for x in ("n", "all", "kinds")]))).alias("steps"))

    def logp(v: str) -> Column:
        n, total, kinds = (lambda x, name=name: x[f"{name}_{v}"] for name in ("n", "all", "kinds"))
        return F.log(F.aggregate("steps", F.lit(1 / 257), lambda p, x: F.when(total(x) > 0, (n(x) + kinds(x) * p) / (total(x) + kinds(x))).otherwise(p)))

    said = steps.select(F.col("full").alias("context"), "char", F.round((logp("good") - logp("bad")) * UNIT).cast("long").alias("value"))
    return placed.join(said, ["context", "char"], "left").groupBy("id").agg((F.sum(F.coalesce("value", F.lit(0)) * F.col("n")) / UNIT / F.sum("n")).alias("score"))


def apply(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score and p_allow."""
    bounded(pages.sparkSession)
    host, path, text = parts(F.col("url"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: len(r[1])):
        here = fits(F.col("host"), F.col("path"), name)
        rule, verdict = F.when(here, F.lit(name)).otherwise(rule), F.when(here, F.lit(kind)).otherwise(verdict)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "text")
    held = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) % 5 == 0
    texts = keep(rows.select("text", (F.col("ruled") == "allow").alias("good")).distinct().select(F.monotonically_increasing_id().alias("id"), "text", "good", held.alias("held")), "urls")
    fitted = texts.where("good is not null and not held")
    scored, a, b = texts.select("text", F.lit(0.0).alias("score")), 0.0, 0.0
    if fitted.select("good").distinct().count() == 2:
        scored = keep(texts.join(scores(texts, fitted, order), "id", "left").select("text", "good", "held", F.coalesce("score", F.lit(0.0)).alias("score")), "url_scores")
        a, b = calibrated(scored.where("good is not null and held"))
    p = F.when(F.col("score") == 0, 0.5).otherwise(chance(F.col("score"), a, b))
    judged = rows.join(scored.select("text", "score"), "text").withColumn("p_allow", p)
    verdict = F.coalesce("ruled", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "p_allow")
