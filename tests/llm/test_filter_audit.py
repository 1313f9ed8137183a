"""The audit against a plain version that applies every order of filters to every row."""

import re
from collections import Counter
from itertools import permutations

from lodestream.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    marks, least = {}, {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = marks.get(i, (0, 0))
            marks[i] = max(good, quality or 0), max(bad, toxic or 0)
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = {}
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 200, 2 * len(set(words)) < len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text])
        fails.setdefault(part or "", []).append(({x for x, bad in zip("ABCDE", tests, strict=True) if bad}, marks.get(i, (0, 0))))
    out = {}
    for part, rows in fails.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, x in enumerate(order):
                gone, stay = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                out[part, order, k + 1] = [len(stay), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1][0] == 1 for r in gone), sum(r[1][1] == 1 for r in gone)]
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                out[part, order, k + 1].append(shapley[x])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = filter_audit.apply(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


def test_edges(spark):
    """Nulls, empty texts, white space only, one very long text, copies, repeated rows and ids, ties of labels, each filter alone."""
    plain = " ".join(f"w{i}" for i in range(250))
    docs = [(i, plain, "en") for i in (9, 3, 5)] + [(3, plain, "en"), (3, plain, "de"), (None, plain, "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (4, " \n\t ", None)]
    docs += [(10, "la " * 400, "fr"), (11, plain.upper(), "fr"), (12, f"{plain} 100%", "fr"), (13, "a\x0bb\x0cc a A | B", "fr"), (14, "été " * 3 + " x", ""), (15, plain + " x" * 60_000, "en"), (16, "Ab é" * 9, "en"), (16, "other", "en")]
    labels = [(3, 1, 0), (3, 0, 1), (9, None, 1), (None, 1, 1), (10, 1, None), (12, 1, 1), (99, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 7, 8, 9, 1)], "doc_id long, text string, lang string, k1 int, key int, n int, good int")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    assert filter_audit.apply(docs, labels).where("good_lost = 1").count() == 120


def test_no_exchange_of_words(spark, sf_dir):
    """Words are aggregated where their text is: only texts, merged in every task, move."""
    plan = filter_audit.text_flags(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [after.split("Aggregate", 1)[1] for after in plan.split("Exchange hashpartitioning")[1:]]
    assert len(exchanges) == 2 and all("partial_first(text" in x.split(")")[0] + x.split("functions=", 1)[1][:40] for x in exchanges)
