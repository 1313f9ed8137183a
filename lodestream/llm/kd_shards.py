"""Shards of near equal bytes by a k-d tree over metadata.

A node that is to become k shards is cut along its widest dimension where the share floor(k / 2) / k
of its bytes lies: a weighted median. Cutting ends when a leaf is one shard, that is when it has
reached the target of total / shards bytes. Rows of one shard are then near one another in source,
language, length and id, so a reader can skip shards by their metadata.

Medians are found without sorting: every round counts bytes in BUCKETS buckets of the interval that
still holds the cut of each node, in one aggregation that every task pre-aggregates, and goes on
inside the bucket in which the cut falls; equal coordinates are told apart by a hash of the row. A
cut is exact to half a row. The driver holds one cut and one interval per node, which the number of
shards bounds; rows never pass through it. Slots are counted in two levels, per range of the hash
and then over ranges, so no window spans a shard.

Texts are read once: ids, sizes, checksums and metadata are written to the shared folder, and the
rounds read only that. Equal rows are merged in every task before they move and get a copy number,
so the result does not depend on how files are split, and no key grows with the copies of a row.

Defined results: a null text has no bytes, size 1 and checksum 0; a null or NaN coordinate counts as
-1; empty texts are rows like others; a text larger than the target makes its shard as large as
itself; repeated rows may go to different shards; equal texts are not kept together, since the law
is that of bytes; with fewer rows than shards some shards are empty; columns that are not named
are not read, whatever they are called; an empty table gives no rows. Sizes come from the lengths of
whole texts, however long.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import keep

#: Buckets of a node's interval per round: three rounds tell 10^10 evenly spread values apart.
BUCKETS = 4096
#: Copies of one row that are numbered in one go; more are dealt to tasks in blocks of so many.
BLOCK = 100_000
#: Hexadecimal digits of the hash that orders equal coordinates: whole numbers that a double holds.
DIGITS = 13


@dataclass
class _Node:
    """A node of one level: `id` in heap order, its shards, and where its cut is searched for."""

    id: int
    first: int
    shards: int
    dim: int = 0
    goal: int = 0
    before: int = 0
    lo: float = 0.0
    hi: float = 0.0
    at: float | None = None  # the coordinate, once only equal ones are left
    cut: tuple[int, float, float] | None = None


def _hashed(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _coordinate(df: DataFrame, name: str, logarithmic: bool) -> Column:
    """Categories by their hash: equal ones lie together, their order means nothing."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        value = F.when(F.col(name).isNotNull(), _hashed(F.col(name)).cast("double"))
    else:
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        value = F.when(value >= 0, F.log2(1 + value)).otherwise(value) if logarithmic else value
    return F.coalesce(value, F.lit(-1.0))


def _rows(docs: DataFrame, doc_id: str, text: str, dims: Sequence[str], logarithmic: Sequence[str]) -> DataFrame:
    """(id, size, crc, c, tie): one small row per document, with its coordinates and the hash that orders equal ones."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    names = [f"d{i}" for i in range(len(dims))]
    merged = docs.select(F.col(doc_id).alias("id"), size.alias("size"), crc.alias("crc"), *(F.col(d).alias(n) for d, n in zip(dims, names, strict=True)))
    merged = merged.groupBy(*merged.columns).agg(F.count("*").alias("copies"))
    numbers = lambda a, b: F.explode(F.sequence(a, b))
    few = merged.where(F.col("copies") <= BLOCK).withColumn("copy", numbers(F.lit(0).cast("long"), F.col("copies") - 1))
    many = merged.where(F.col("copies") > BLOCK).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    many = many.repartition("id", "crc", "_block").withColumn("copy", numbers(F.col("_block"), F.least(F.col("_block") + BLOCK, "copies") - 1)).drop("_block")
    rows = few.unionByName(many)
    place = F.array(*(_coordinate(rows, n, d in logarithmic) for d, n in zip(dims, names, strict=True)))
    return rows.select("id", "size", "crc", place.alias("c"), _hashed(*(F.col(x) for x in ("id", "size", "crc", *names, "copy"))).alias("tie"))


def _node(cuts: dict[int, tuple[int, float, float]], levels: int) -> Column:
    """The node that a row has come to: down one level at a time, by the cut of the node it is in."""
    if not cuts:
        return F.lit(1)
    kind = "struct<dim:int,at:double,tie:double>"
    told = F.array(*(F.struct(*(F.lit(x) for x in cuts[i])).cast(kind) if i in cuts else F.lit(None).cast(kind) for i in range(max(cuts) + 1)))

    def down(node: Column, _: Column) -> Column:
        cut = F.get(told, node)
        x = F.element_at("c", cut["dim"] + 1)
        right = (x > cut["at"]) | ((x == cut["at"]) & (F.col("tie") > cut["tie"]))
        return F.when(cut.isNull(), node).otherwise(2 * node + right.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), down)


def _extents(placed: DataFrame, dims: int) -> dict[int, tuple[int, list[tuple[float, float]]]]:
    """Bytes and extent in each dimension of every node: one row per node."""
    ends = [f(F.get("c", F.lit(i))).alias(f"{name}{i}") for i in range(dims) for name, f in (("lo", F.min), ("hi", F.max))]
    return {r.node: (r.bytes, [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(dims)]) for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}


def _round(placed: DataFrame, nodes: list[_Node]) -> None:
    """Narrows the interval of every node that has no cut yet to the bucket in which its cut falls."""
    kind = "struct<dim:int,lo:double,hi:double,at:double,goal:long>"
    last = max(n.id for n in nodes)
    by = {n.id: n for n in nodes}
    asked = F.array(*(F.struct(F.lit(by[i].dim), F.lit(by[i].lo), F.lit(by[i].hi), F.lit(by[i].at), F.lit(by[i].goal - by[i].before)).cast(kind) if i in by else F.lit(None).cast(kind) for i in range(last + 1)))
    told = placed.withColumn("q", F.get(asked, F.col("node"))).where("q is not null").withColumn("x", F.element_at("c", F.col("q.dim") + 1))
    told = told.where("q.at is null or x = q.at").select("node", "size", "q", F.when(F.col("q.at").isNull(), F.col("x")).otherwise(F.col("tie").cast("double")).alias("p")).where("p >= q.lo and p <= q.hi")
    bucket = F.when(F.col("q.hi") > F.col("q.lo"), F.least(F.floor((F.col("p") - F.col("q.lo")) / (F.col("q.hi") - F.col("q.lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
    counts = told.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.first("q.goal").alias("goal"))
    so_far = counts.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket")))  # at most BUCKETS rows a node
    for r in so_far.where("upto >= goal and upto - bytes < goal").collect():
        node, n = by[r.node], r.upto - r.bytes
        node.before += n
        node.lo, node.hi = r.lo, r.hi
        if r.lo < r.hi:
            continue
        if node.at is None and r.n > 1:
            node.at, node.lo, node.hi = r.lo, 0.0, float(16**DIGITS)
            continue
        # what stands at the cut goes left if that is nearer to the goal
        at, tie = (r.lo, float(16**DIGITS)) if node.at is None else (node.at, r.lo)
        nearer = 2 * (node.goal - node.before) >= r.bytes
        node.cut = (node.dim, at, tie) if nearer else (node.dim, at, -1.0 if node.at is None else tie - 1)


def tree(rows: DataFrame, shards: int, dims: int) -> tuple[dict[int, tuple[int, float, float]], dict[int, int]]:
    """Cuts by node, and shards by leaf. Rows up to (coordinate, hash) of a cut go left."""
    level, cuts, leaves, widths, depth = [_Node(1, 0, shards)], {}, {}, [], 0
    while level:
        leaves |= {n.id: n.first for n in level if n.shards == 1}
        level = [n for n in level if n.shards > 1]
        if not level:
            break
        placed = rows.select("c", "tie", "size", _node(cuts, depth).alias("node"))
        extents = _extents(placed, dims)
        for n in level:
            if n.id not in extents:
                continue
            total, ends = extents[n.id]
            widths = widths or [hi - lo for lo, hi in ends]
            n.dim = max(range(dims), key=lambda i: ((ends[i][1] - ends[i][0]) / widths[i] if widths[i] else 0.0, -i))
            n.lo, n.hi = ends[n.dim]
            n.goal = total * (n.shards // 2) // n.shards
            if n.goal < 1:
                n.cut = (n.dim, n.lo, -1.0)
        while left := [n for n in level if n.id in extents and n.cut is None]:
            _round(placed, left)
        cuts |= {n.id: n.cut or (0, math.inf, 0.0) for n in level}
        level = [_Node(2 * n.id + side, n.first + side * (n.shards // 2), (n.shards - n.shards // 2) if side else n.shards // 2) for n in level for side in (0, 1)]
        depth += 1
    return cuts, leaves


def assign(docs: DataFrame, shards: int, dims: Sequence[str], doc_id: str = "doc_id", text: str = "text", logarithmic: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots count each shard's rows without gaps, in the order of a hash of the row."""
    if shards < 1 or not dims:
        raise ValueError("at least one shard and one dimension are needed")
    rows = keep(_rows(docs, doc_id, text, dims, logarithmic), "shard_rows")
    cuts, leaves = tree(rows, shards, len(dims))
    numbers = F.array(*(F.lit(leaves.get(i)).cast("int") for i in range(max(leaves) + 1)))
    placed = rows.select("id", "size", "crc", "tie", F.get(numbers, _node(cuts, max(leaves).bit_length() - 1)).alias("shard"))
    # as many ranges a shard as rows a range
    bits = max(0, round(math.log2(max(1, rows.count() / shards)) / 2))
    placed = placed.withColumn("_range", F.shiftright("tie", 4 * DIGITS - bits))
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_range").orderBy("tie", "id", "crc", "size")
    slot = (F.row_number().over(inside) - 1 + F.col("_before")).cast("long")
    return placed.join(before, ["shard", "_range"]).select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents in 16 shards of near equal bytes."""
    found = assign(docs, 16, ("source", "lang", "n_chars", "doc_id"), logarithmic=("n_chars",))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
