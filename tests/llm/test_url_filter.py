import math

import pytest

from lodestream.llm import url_filter
from lodestream.llm.url_filter import Markov, Ratio, calibrate, fit


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def ruled(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        domain, _, prefix = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


ODD = [
    None, "", "nothing", "://", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://example.net/en/1", "http://m.example.net/en", "http://example.net/EN/1", "http://example.net?x=/en/", "http://example.net/#/en/",
    "http://É.Net/É?q#f", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x://y", "http://b.org/es/", "ftp://x.example.com/de/?a=b#c", "a://b://c.net/x", "http://x.com/" + "long" * 5000, "http://a.net\n/x",
]


def test_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(1000 + i, u) for i, u in enumerate(ODD)] + [(1000, ODD[0]), (None, ODD[6])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'v' as verdict")
    out = url_filter.apply(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    for i, u in rows:
        host, path = parse(u)
        rule, verdict = ruled(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), u
        assert by[i].verdict == (verdict or by[i].verdict) and by[i].verdict in ("allow", "block")


def test_model_equals_plain_witten_bell():
    texts = ["abcab", "abd", "xyz", "abab"]
    model = Markov(texts, 2)

    def plain(context, char):
        p = 1 / 257
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            after = [t[i + len(c)] for t in ("\x02" + x + "\x03" for x in texts) for i in range(len(t) - len(c)) if t[i : i + len(c)] == c and i + len(c) >= 1]
            if not after:
                break
            kinds = len(set(after))
            p = (after.count(char) + kinds * p) / (len(after) + kinds)
        return math.log(p)

    for context in ("", "a", "ab", "zz", "xa"):
        for char in "abcdxyz\x03":
            assert model.logp(context, char) == pytest.approx(plain(context, char))


def test_separates_classes_and_is_held_out():
    good, bad = [f"news{i}.site.org/story/{i}" for i in range(200)], [f"ads{i}.track.biz/click?{i}" for i in range(200)]
    ratio, a, b = fit([(t, True, i % 5 == 0) for i, t in enumerate(good)] + [(t, False, i % 5 == 0) for i, t in enumerate(bad)])
    assert a > 0
    assert a * ratio("news999.site.org/story/999") + b > 0 > a * ratio("ads999.track.biz/click?999") + b
    assert ratio("") == 0 and isinstance(ratio, Ratio)
    assert fit([("a", True, False)]) is None
    assert calibrate([1.0, 2.0], [True, True]) == (1.0, 0.0)


def test_held_out_accuracy_on_the_table(spark):
    """Rules' own verdicts on URLs that the models never saw."""
    out = url_filter.apply(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("rule is not null").collect()
    assert sum((r.p_allow >= 0.5) == (r.verdict == "allow") for r in out) / len(out) > 0.9


def test_empty(spark):
    assert url_filter.apply(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_verdicts_equal_brute_force(spark):
    """Both models by searching all labelled texts, the curve by its own Newton steps, on every page that no rule fits."""
    import numpy as np
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(1000 + i, u) for i, u in enumerate(ODD) if u is None or len(u) < 100]

    def whole(url):
        host = parse(url)[0]
        return host + url.split("://", 1)[1][len(host) :] if url is not None and "://" in url else ""

    labels = {whole(u): ruled(*parse(u))[1] for _, u in rows if ruled(*parse(u))[1]}
    held = {r.t for r in spark.createDataFrame([(t,) for t in labels], "t string").where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) % 5 == 0).collect()}
    texts = {v: ["\x02" + t + "\x03" for t, x in labels.items() if x == v and t not in held] for v in ("allow", "block")}
    order, memo = 3, {}

    def after(kind, context):
        """The characters that follow a context in the texts of a verdict."""
        if (kind, context) not in memo:
            n = len(context)
            memo[kind, context] = [t[i] for t in texts[kind] for i in range(max(1, n), len(t)) if t[i - n : i] == context]
        return memo[kind, context]

    def logp(kind, context, char):
        p = 1 / 257
        for k in range(len(context) + 1):
            found = after(kind, context[len(context) - k :])
            p = (found.count(char) + len(set(found)) * p) / (len(found) + len(set(found))) if found else p
        return math.log(p)

    def score(text):
        t = "\x02" + text + "\x03"
        both = [logp("allow", t[max(0, i - order) : i], t[i]) - logp("block", t[max(0, i - order) : i], t[i]) for i in range(1, len(t))]
        return sum(both) / (len(t) - 1) if text else 0.0

    x = np.array([[score(t), 1.0] for t in sorted(held)])
    y = np.array([labels[t] == "allow" for t in sorted(held)], float)
    assert 0 < y.sum() < len(y)
    w, beta = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag([1e-3, 1e-9]), x.T @ (w * (y - p)) - np.array([1e-3, 0]) * beta)
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.apply(df, order=order).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        s, chance = score(whole(u)), 0.5
        assert got[i].score == pytest.approx(s, abs=1e-9)
        if whole(u):
            chance = 1 / (1 + math.exp(-(beta[0] * s + beta[1])))
        assert got[i].p_allow == pytest.approx(chance, abs=1e-3)
        if abs(chance - 0.5) > 1e-3 or not whole(u):
            assert got[i].verdict == (ruled(*parse(u))[1] or ("allow" if chance >= 0.5 else "block"))


def test_every_labelled_url_counts(spark):
    """More than 20,000 distinct URLs of a verdict: the counts are those of all that are not held out, none is drawn."""
    from pyspark.sql import functions as F

    texts = spark.range(0, 26_000).select((F.col("id") % 26 > 0).alias("good"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("text"))
    pairs, contexts = url_filter.counts_of(texts, 1)
    start = pairs.where("context = '\x02' and char = 'a'").first()
    assert (start.n_good, start.n_bad) == (25_000, 1_000)
    whole = contexts.where("context = ''").first()
    chars = texts.groupBy("good").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    assert {r.good: r.n for r in chars} == {True: whole.all_good, False: whole.all_bad} and whole.kinds_good == 12
