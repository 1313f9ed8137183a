import random
import re

import numpy as np

from lodestream.llm import decontaminate
from lodestream.llm.decontaminate import Index

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def grams(text, k=5):
    w = WORD.findall((text or "").lower())
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, items, overlap=0.8):
    """Every document against every item by shingles alone."""
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, item in items:
            want = grams(item)
            k = min(5, len(WORD.findall((item or "").lower())))
            have = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if k else set()
            if want and len(want & have) >= overlap * len(want):
                out.add((d, i))
    return out


def case():
    r = random.Random(5)
    common = ["the", "of", "and", "a", "to"]
    vocab = ["".join(r.choice("abcdefgé") for _ in range(6)) for _ in range(800)]
    say = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randint(12, 60)) + (f"\n{say(r.randint(3, 9))}" if i % 2 else "")) for i in range(60)]
    docs = []
    for d in range(200):
        text = say(r.randint(0, 600))
        if d % 4 == 0:
            item = r.choice(items)[1]
            text = f"{text} {item.upper() if d % 8 else item}### {say(r.randint(0, 300))}"
        if d % 10 == 1:  # less than the threshold of an item
            half = r.choice(items)[1].split()
            text += " " + " ".join(half[: len(half) // 2])
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id").repartition(3)
    table = spark.createDataFrame([*items, (60, None), (61, ""), (62, items[3][1])], "item_id long, text string")
    want = sorted([(d, i) for d, i in brute(docs, [*items, (62, items[3][1])])], key=str)
    for shard in (20_000, 7):
        rows = decontaminate.apply(df, table, shard_items=shard).collect()
        assert sorted({(r.doc_id, r.item_id) for r in rows}, key=str) == want
        assert all(r.score >= decontaminate.THRESHOLD - 1e-9 for r in rows)
        clean = decontaminate.clean(df, table, shard_items=shard)
        assert clean.columns == df.columns
        assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([d for d, _ in docs if d not in {a for a, _ in want}], key=str)


def test_block_max_wand_is_exact():
    _, items = case()
    index = Index(items)
    r = random.Random(1)
    for _ in range(200):
        terms = np.array(sorted(r.sample(range(len(index.terms)), r.choice([2, 30, 150]))))
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.items[t]] += index.impacts[t]
        assert {i for i, _ in index.wand(terms)} == set(np.flatnonzero(scores >= index.threshold - 1e-9).tolist())


def test_candidates_lose_nothing():
    _, items = case()
    index = Index(items)
    r = random.Random(2)
    passages = [np.array(sorted(r.sample(range(len(index.terms)), 120))) for _ in range(50)]
    passage = np.concatenate([np.full(len(p), i) for i, p in enumerate(passages)])
    found = set(index.candidates(passage, np.concatenate(passages)).tolist())
    assert {i for i, p in enumerate(passages) if index.wand(p)} <= found


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.apply(docs, items).collect() == []
    assert decontaminate.clean(docs, items).count() == 1
    assert decontaminate.apply(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_scores_do_not_depend_on_shards(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    runs = []
    for order, shard in ((items, 20_000), (items, 7), (items[::-1], 11)):
        rows = decontaminate.apply(df, spark.createDataFrame(order, "item_id long, text string"), overlap=0.2, shard_items=shard).collect()
        runs.append(sorted([(r.doc_id, r.item_id, round(r.score, 9)) for r in rows], key=str))
    assert runs[0] == runs[1] == runs[2] and any(s < 0.99 for *_, s in runs[0])


def test_long_items_at_any_offset(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefg") for _ in range(7)) for _ in range(5000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(0, say(40)), (1, say(600)), (2, say(900)), (3, say(2000)), (4, say(2000))]
    docs = [(10 * i + k, f"{say(before)} {text} {say(700)}") for i, text in items for k, before in enumerate((0, 130, 256, 500, 777, 1999, 3001))]
    docs.append((90, say(9000)))
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard in (20_000, 2):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.apply(df, table, shard_items=shard).collect()) == sorted((d, d // 10) for d, _ in docs[:-1])
        assert [r.doc_id for r in decontaminate.clean(df, table, shard_items=shard).collect()] == [90]
