"""Trie of conversation prefixes: who shares the first turns, and what a cache of prefixes saves.

Texts never move: a turn travels as a digest of 32 bytes and its length. Turns are numbered per
conversation, conversations rebuilt by key joins, and every prefix named by 128 bits of a hash
chained along its conversation, streamed in (conversation, depth) order with one digest of state.

Subtrees of at most `shard_rows` turns are the prefix shards. A task builds the tries of its shards
one after another with numpy: nodes in level order, their labels, and a LOUDS bit vector (each
node's number of children in unary), from which parents are read by rank; rollups add every level
to its parents in reverse level order (add.at). Nodes above the shards, the heavy upper levels, are
merged separately: each shard hands its root's totals to its parent, every heavy node stands once for
all its conversations, and the same builder runs on these nodes, in rounds until none is heavy. A
common first turn, or copies of a whole conversation, so cost a task no more than `shard_rows`
turns. Ids that end at a heavy node are hashed from sorted blocks of ids in a stream.

Defined results: rows without a conv_id belong to no conversation; turns are ordered by number, null
first, and equal numbers by role, the text's first 64 characters and its digest; repeated rows are
turns like others; null roles and texts are empty; the remainder of a negative id has its sign; very
long texts count by their bytes and very long conversations pass through a task in a stream; extra
columns are not read, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded, drop_kept, keep

#: Turns of the largest subtree that one task holds, and rows that it gathers before it builds.
SHARD_ROWS, GATHER_ROWS = 10_000, 50_000
#: Conversations that give their first turns to others, and how many turns at most.
DONORS, BORROWED = 5, 8
#: Ids of a block that is hashed in one go.
BLOCK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
PATH, ABOVE, SHARD = ["p1", "p2"], ["q1", "q2"], ["s1", "s2"]
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(id, pos, key, bytes): the turns of every conversation, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    told = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "key")
    return told.withColumn("pos", F.row_number().over(order)).select("id", "pos", "key", "bytes")


def rebuilt(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (id, length) and their turns (id, depth, length, key, bytes) after each took the first turns of its donor."""
    ids = told.groupBy("id").agg(F.max("pos").alias("n"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % (BORROWED + 1)).cast("int")
    donor = F.col("id") - F.col("id") % DONORS
    theirs = ids.select(F.col("id").alias("donor"), F.col("n").alias("has"))
    convs = ids.select("id", "n", h.alias("h"), donor.alias("donor")).join(theirs, "donor", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    heads = told.where((F.col("id") % DONORS == 0) & (F.col("pos") <= BORROWED)).select(F.col("id").alias("donor"), "pos", "key", "bytes")
    taken = convs.join(heads, "donor").where("pos <= h").select("id", F.col("pos").alias("depth"), "length", "key", "bytes")
    own = told.join(convs, "id").where("pos > h").select("id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "length", "key", "bytes")
    return convs.select("id", "length"), taken.unionByName(own)


def paths(rows: DataFrame) -> DataFrame:
    """(id, depth, length, bytes, p1, p2, q1, q2): every turn with the name of its prefix and of the prefix before it."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, above = None, bytes(16)
        for b in batches:
            here, before = [], []
            for i, key in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), strict=True):
                if i != last:
                    last, above = i, bytes(16)
                before.append(above)
                above = hashlib.blake2b(above + key, digest_size=16).digest()
                here.append(above)
            cut = [np.frombuffer(b"".join(x), dtype="<i8").reshape(-1, 2) for x in (here, before)]
            columns = [b.column(c) for c in ("id", "depth", "length", "bytes")] + [pa.array(np.ascontiguousarray(x[:, k])) for x in cut for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "depth", "length", "bytes", *PATH, *ABOVE])

    in_order = rows.select("id", F.col("depth").cast("long"), F.col("length").cast("long"), "bytes", "key").repartition("id").sortWithinPartitions("id", "depth")
    return in_order.mapInArrow(chained, "id long, depth long, length long, bytes long, p1 long, p2 long, q1 long, q2 long")


def _louds(degrees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit vector of a trie in level order, and each node's parent read from it: the zeros before the node's one. Number 0 is the root of all."""
    bits = np.ones(int(degrees.sum()) + len(degrees), dtype=bool)
    bits[np.cumsum(degrees + 1) - 1] = False
    return bits, np.cumsum(~bits)[bits]


def build(t: dict[str, np.ndarray], merged: bool) -> dict[str, np.ndarray]:
    """The nodes of whole shards in level order with their rollups.

    t holds a row per conversation and depth. With `merged`, a row stands for a node of which n,
    first and the totals of what hangs below it (leaves, saved, kids) are known.
    """
    by_conv = np.lexsort((t["depth"], t["id"]))
    follows = np.r_[False, t["id"][by_conv][1:] == t["id"][by_conv][:-1]]
    runs = np.arange(len(by_conv))
    level_of = np.empty(len(by_conv), dtype=np.int64)
    level_of[by_conv] = runs - np.maximum.accumulate(np.where(follows, 0, runs))
    order = np.lexsort((t["id"], t["p2"], t["p1"], level_of))
    t = {k: v[order] for k, v in t.items()}
    level_of = level_of[order]
    new = np.r_[True, (t["p1"][1:] != t["p1"][:-1]) | (t["p2"][1:] != t["p2"][:-1]) | (level_of[1:] != level_of[:-1])]
    node, start = np.cumsum(new) - 1, np.flatnonzero(new)
    # the row before a row in its conversation is its parent's; -1: a shard's root
    place = np.empty(len(order), dtype=np.int64)
    place[order] = node
    along = place[by_conv]
    parent = np.full(len(start), -1)
    parent[along[follows]] = along[np.flatnonzero(follows) - 1]
    # level order: within a level by the parent's rank, then by label
    levels = np.searchsorted(level_of[start], np.arange(level_of[-1] + 2))
    rank, at = np.empty(len(start), dtype=np.int64), np.empty(len(start), dtype=np.int64)
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        o = a + np.argsort(np.where(parent[a:b] < 0, 0, rank[parent[a:b]]), kind="stable")
        rank[o], at[a:b] = np.arange(a, b), o
    degrees = np.bincount(np.where(parent < 0, 0, rank[parent] + 1), minlength=len(start) + 1)
    _, above = _louds(degrees)

    first = t["first"][start][at] if merged else t["id"][start][at]
    n = t["n"][start][at] if merged else np.bincount(node)[at]
    below = {k: t[k][start][at] if merged else np.zeros(len(start), dtype=np.int64) for k in ("leaves", "saved", "kids")}
    kids = degrees[1:] + below["kids"]
    leaves, saved = np.r_[0, np.where(kids == 0, 1, below["leaves"])], np.r_[0, (n - 1) * t["bytes"][start][at] + below["saved"]]
    for a, b in zip(levels[-2::-1], levels[:0:-1], strict=True):
        np.add.at(leaves, above[a:b], leaves[a + 1 : b + 1])
        np.add.at(saved, above[a:b], saved[a + 1 : b + 1])
    top = above == 0
    up = np.where(top, t["up"][start][at], np.r_[0, first][above])
    out = {"conv_id": first, "depth": t["depth"][start][at], "parent_conv_id": up, "n_convs": n, "n_children": kids, "n_leaves": leaves[1:], "saved_tokens": saved[1:], "top": top}
    out |= {k: t[k][start][at] for k in (*PATH, *ABOVE)}
    out["ends_sha256"] = np.full(len(start), EMPTY_SHA, dtype=object)
    if not merged:
        ends = np.flatnonzero(t["depth"] == t["length"])
        for rows in np.split(ends, np.flatnonzero(np.diff(node[ends])) + 1) if len(ends) else []:
            out["ends_sha256"][rank[node[rows[0]]]] = hashlib.sha256(",".join(map(str, t["id"][rows].tolist())).encode()).hexdigest()
    return out


def shards(rows: DataFrame, merged: bool) -> DataFrame:
    """All nodes of the shards, from rows that know their shard (s1, s2) and the conversation above it (up)."""
    schema = f"{_NODE}, top boolean, p1 long, p2 long, q1 long, q2 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def result(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = build(t, merged)
            yield from pa.Table.from_arrays([pa.array(out[k]) for k in names], names=names).to_batches(max_chunksize=GATHER_ROWS)

        for b in batches:
            held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names})
            if sum(len(h["id"]) for h in held) < GATHER_ROWS:
                continue
            t = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            last = (t["s1"] == t["s1"][-1]) & (t["s2"] == t["s2"][-1])  # the last shard may go on
            if not last.all():
                yield from result({k: v[~last] for k, v in t.items()})
            held = [{k: v[last] for k, v in t.items()}]
        if held and sum(len(h["id"]) for h in held):
            yield from result({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    return rows.repartition(*SHARD).sortWithinPartitions(*SHARD).mapInArrow(built, schema)


def _split(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Heavy nodes (path, above, depth, n, first, bytes, cost), and the rows with `heavy`, their shard and the conversation above it."""
    cost = F.sum(F.col("length") - F.col("depth") + 1)
    nodes = rows.groupBy(*PATH).agg(cost.alias("cost"), F.count("*").alias("n"), F.min("id").alias("first"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"), *(F.max(c).alias(c) for c in ABOVE))
    heavy = keep(nodes.where(F.col("cost") > shard_rows), "heavy_nodes")
    marked = rows.join(heavy.select(*PATH, F.col("first").alias("_first"), F.lit(True).alias("heavy")), PATH, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    whole = Window.partitionBy("id")
    light = F.min(F.when(~F.col("heavy"), F.struct("depth", *PATH))).over(whole)
    above = F.max(F.when(F.col("heavy"), F.struct("depth", "_first"))).over(whole)
    marked = marked.withColumns({"_light": light, "_above": above}).select("*", *(F.col(f"_light.{p}").alias(s) for p, s in zip(PATH, SHARD, strict=True)), F.col("_above._first").alias("up"))
    return heavy, marked.drop("_light", "_above", "_first")


def _ends(ending: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of (p1, p2, id): ids in order, in blocks, hashed in a stream with one hash of state."""
    blocks = ending.groupBy(*PATH, F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        told = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([state.hexdigest()])], names=[*PATH, "ends_sha256"])
        for b in batches:
            for p1, p2, ids in zip(*(b.column(c).to_pylist() for c in (*PATH, "ids")), strict=True):
                if last == (p1, p2):
                    state.update(b",")
                else:
                    if last is not None:
                        yield told()
                    last, state = (p1, p2), hashlib.sha256()
                state.update(ids.encode())
        if last is not None:
            yield told()

    return blocks.repartition(*PATH).sortWithinPartitions(*PATH, "block").select(*PATH, "ids").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def _totals(nodes: DataFrame) -> DataFrame:
    """What the shards' roots hand to the nodes above them."""
    return nodes.where("top").groupBy(*(F.col(q).alias(p) for p, q in zip(PATH, ABOVE, strict=True))).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("kids"))


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    bounded(conversations.sparkSession)
    told = keep(turns(conversations), "turns")
    convs, rows = rebuilt(told)
    convs, rows = keep(convs, "conversations"), keep(paths(rows), "paths")
    root = F.lit(0).cast("long")
    ending = convs.where("length = 0").select(root.alias("p1"), root.alias("p2"), "id")
    done, totals, merged, level, chains, used = [], [], False, rows, rows, [told, convs, rows]
    while True:
        heavy, marked = _split(level, shard_rows)
        any_heavy = not heavy.isEmpty()
        used.append(heavy)
        if any_heavy:
            marked = keep(marked, "marked")
            used.append(marked)
        light = marked.where(~F.col("heavy")).withColumn("up", F.coalesce("up", F.lit(-1).cast("long")))
        nodes = keep(shards(light.select("id", "depth", "length", "bytes", *PATH, *ABOVE, *SHARD, "up", *(("n", "first", "leaves", "saved", "kids") if merged else ())), merged), "nodes")
        done.append(nodes.withColumn("merged", F.lit(merged)))
        totals.append(_totals(nodes))
        if not any_heavy:
            break
        if not merged:
            ending = ending.unionByName(marked.where("heavy and depth = length").select(*PATH, "id"))
        known = heavy if not merged else heavy.drop("n", "first", "bytes").join(level.select(*PATH, "n", "first", "bytes", *(F.col(c).alias(f"_{c}") for c in ("leaves", "saved", "kids"))).dropDuplicates(PATH), PATH)
        known = known.join(totals[-1], PATH, "left")
        sums = ((F.coalesce(c, F.lit(0)) + (F.col(f"_{c}") if merged else F.lit(0))).cast("long").alias(c) for c in ("leaves", "saved", "kids"))
        known = keep(known.select(*PATH, *ABOVE, "depth", "n", "first", "bytes", *sums), "known")
        # one conversation for each heavy node leads to it from the top
        chains = chains.select("id", "depth", *PATH).join(known.select(F.col("first").alias("id")).distinct(), "id")
        level = chains.join(known.drop("depth"), PATH)
        level = keep(level.withColumn("length", F.max("depth").over(Window.partitionBy("id"))), "upper")
        used += [known, level]
        chains, merged = level, True
    ends = keep(_ends(ending), "ends")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    if len(done) > 1:
        every = every.join(ends.withColumnRenamed("ends_sha256", "_ends"), PATH, "left").withColumn("ends_sha256", F.when(F.col("merged"), F.coalesce("_ends", F.lit(EMPTY_SHA))).otherwise(F.col("ends_sha256")))
    all_ = convs.agg(F.min("id").alias("least"), F.count("*").alias("n")).first()
    every = every.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(all_.least)).otherwise(F.col("parent_conv_id")))
    up = totals[0]
    for more in totals[1:]:
        up = up.unionByName(more)
    at_root = (F.col("p1") == 0) & (F.col("p2") == 0)
    up = up.where(at_root).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaves", "saved", "kids"))).first()
    ended = ends.where(at_root).agg(F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA)).alias("sha")).first()
    row = (all_.least, 0, None, all_.n, up.kids, up.leaves if up.kids else 1, up.saved, ended.sha)
    kinds = dict(x.split() for x in _NODE.split(", "))
    drop_kept(*used)
    top = conversations.sparkSession.range(1 if all_.n else 0).select(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds.items(), strict=True)))
    return every.select(*kinds).unionByName(top)


def apply(conversations: DataFrame) -> DataFrame:
    return trie(conversations)
