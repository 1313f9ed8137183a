import random
import re
import time

import numpy as np
import pytest

from lodestream.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, k, threshold):
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[s : s + k]) for s in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = [(-1 if i is None else i) for i, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    up = lambda i: None if i == -1 else i
    return sorted([(up(i), len(s), up(find(i))) for i, s in zip(ids, sets, strict=True)], key=str)


def families(seed):
    """Chains and stars of near copies at every distance around the threshold."""
    r = random.Random(seed)
    rows = []
    for base in range(6):
        words = [f"w{r.randrange(60 if base % 2 else 3000)}" for _ in range(r.choice([6, 12, 40, 150, 400]))]
        for _ in range(25):
            new = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                new[r.randrange(len(new))] = f"x{r.randrange(9)}"
            rows.append((len(rows), " ".join(new)))
            if r.random() < 0.3:
                words = new
    return rows


@pytest.mark.parametrize(("k", "threshold"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, corpus_rows, k, threshold, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 9000)
    rows = corpus_rows + [(1000 + i, t) for s in (1, 2) for i, t in [(x + 500 * s, y) for x, y in families(s)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r) for r in jaccard_join.apply(df, shingle=k, threshold=threshold).collect()], key=str)
    assert got == brute(rows, k, threshold)


def test_second_round(spark, monkeypatch):
    """With a pivot that links to nobody, links among the others come from the second round."""
    words = [f"w{i}" for i in range(300)]
    pivot = words[:275] + ["p"] * 4
    others = [words[:j] + ["q"] + words[j + 1 :] for j in (280, 288, 296)]
    rows = list(enumerate(" ".join(w) for w in [pivot, *others]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_join.apply(df).collect()], key=str) == brute(rows, 3, 90)


def test_prefixes_meet():
    """Any two sets at the threshold share an n-gram of their prefixes."""
    r = np.random.default_rng(3)
    classes = r.integers(0, 4, jaccard_join.CELLS).astype(np.uint8)
    for threshold in (80, 90):
        for n in (1, 5, 9, 19, 40, 120, 500):
            for _ in range(40):
                whole = r.integers(0, 2**63, 2 * n + 1, dtype=np.uint64)
                extra = n * (100 - threshold) // threshold
                cut = int(r.integers(0, extra + 1))
                a, b = np.sort(whole[: n + cut]), np.sort(np.concatenate([whole[:n], whole[n + cut : n + extra]]))
                first, at = jaccard_join.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes, threshold)
                assert set(first[: at[1]].tolist()) & set(first[at[1] :].tolist())


def test_fitting_members_have_a_common_pivot():
    r = np.random.default_rng(5)
    for threshold in (80, 90):
        for _ in range(60):
            n = np.sort(r.integers(1, 120, r.integers(1, 40)))
            stars = {p: set(m.tolist()) for p, m in jaccard_join.star(n, r.permutation(len(n)), threshold)}
            for i in range(len(n)):
                for j in range(i):
                    if n[j] * 100 >= threshold * n[i]:
                        assert any({i, j} <= m | {p} for p, m in stars.items())


def test_empty(spark):
    assert jaccard_join.apply(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_near_copies_without_an_id(spark):
    """Rows that share an id meet only their own text: the work grows with the rows, not with their square."""
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(3000):
        words = list(base)
        words[60] = f"changed{k}"
        rows.append((None, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = jaccard_join.apply(df).collect()
    assert len(got) == 3000 and {x.n_shingles for x in got} == {118} and {x.component_id for x in got} == {None}
    assert time.time() - began < 120
