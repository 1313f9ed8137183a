"""The trie against a plain one of nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from lodestream.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = (*told.get(donor, [])[:h], *ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, done = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [done[k] for k in kids.get(p, ())]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        done[p] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c, end in sorted(members[p]) if end)
        least = lambda q: min(c for c, _ in members[q])
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(below), *done[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, shard_rows=prefix_trie.SHARD_ROWS):
    df = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), shard_rows)
    assert tuple(df.columns) == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def conversations():
    """A common first turn, copies of whole conversations, a long one, ties, nulls, repeated rows, missing donors, negative ids."""
    r = random.Random(3)
    say = lambda k: f"t{r.randrange(k)} é"
    rows = [(c, k, r.choice(["user", "assistant"]), say(3)) for c in range(60, 120) for k in range(r.randint(1, 9))]
    rows += [(c, k, "user", "same" if k == 0 else say(40)) for c in range(200, 240) for k in range(4)]
    rows += [(c, k, "user", f"copy {k}") for c in range(1000, 1060) for k in range(12)]
    rows += [(5000, k, "user", f"long {k}") for k in range(90)]
    rows += [(7, None, None, None), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (7, 1, "a", "x"), (8, 5, "user", "alone" * 5000), (None, 1, "user", "nobody"), (-7, 1, "user", "same"), (-5, 1, "user", "donor"), (10_000_001, 0, "", "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [12, 60, prefix_trie.SHARD_ROWS])
def test_equal_with_any_shards(spark, conversations, shard_rows):
    """Whether no node is heavy, some are or all with more than one turn below them, nodes and rollups are the same."""
    assert found(spark, conversations, shard_rows) == brute(conversations)


def test_small_tables(spark):
    assert found(spark, []) == []
    alone = [(3, 0, "user", "hi")]  # the first turns of a donor that is not there: turnless
    assert found(spark, alone) == brute(alone)
    assert found(spark, [(None, 0, "user", "hi")]) == []


def test_clashing_columns(spark):
    rows = [(10, 1, "user", "a"), (11, 1, "user", "a")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, id int, p1 int, depth int")
    assert sorted([tuple(r) for r in prefix_trie.apply(df).collect()], key=str) == brute(rows)


def test_louds():
    """The bits are each node's children in unary; parents follow from them."""
    import numpy as np

    bits, parents = prefix_trie._louds(np.array([2, 1, 0, 0]))
    assert bits.astype(int).tolist() == [1, 1, 0, 1, 0, 0, 0] and parents.tolist() == [0, 0, 1]
