"""Mixing several streams: options, groups, schedules and batches as tables.

A schedule is a table of steps. It is generated as a range and computed row by row from the step
number, so it has no length limit and needs no state; mixing joins it with the batches of each
stream by (stream, batch number modulo the number of batches).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import batch_sizes, normalize_ratios, ratios_to_counts, share_workers
from ..functions.values import hash_uniform, weighted_pick

SCHEDULES = ("random", "consecutive", "consecutive_interleaved", "random_order", "fixed_random_order")
STRATEGIES = ("no_mixing", "mix_all", "custom")
KEYS = {"name", "ratio", "mixing_group_id", "batch_size", "batch_gpu", "num_accum_rounds", "is_main", "dataloader_kwargs"}


@dataclass(frozen=True)
class StreamOptions:
    name: str
    ratio: float
    mixing_group_id: int
    batch_size: int
    batch_gpu: int
    num_accum_rounds: int = 1
    is_main: bool = False
    extra: dict[str, Any] = field(default_factory=dict)


def stream_group(configs: Sequence[Mapping[str, Any]], world_size: int = 1, strategy: str = "no_mixing", drop_unused: bool = False) -> list[StreamOptions]:
    """Options of several streams with ratios that sum to 1, unique names and valid groups. Unknown keys are errors."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    for c in configs:
        if set(c) - KEYS:
            raise ValueError(f"unknown keys {sorted(set(c) - KEYS)}")
    groups = [c.get("mixing_group_id") for c in configs]
    given = [g for g in groups if g is not None]
    if strategy == "custom" and len(given) < len(groups):
        raise ValueError("a custom strategy needs a mixing_group_id for every stream")
    if strategy == "no_mixing" and given and len(set(groups)) < len(groups):
        raise ValueError("without mixing, groups must differ")
    if strategy == "mix_all" and given and len(set(groups)) > 1:
        raise ValueError("mixing all, groups must agree")
    ratios = normalize_ratios([c.get("ratio") for c in configs])
    out: list[StreamOptions] = []
    for i, (c, ratio) in enumerate(zip(configs, ratios, strict=True)):
        if drop_unused and ratio == 0:
            continue
        name = c.get("name", f"stream_{i:03d}")
        if any(o.name == name for o in out):
            raise ValueError(f"two streams are named {name!r}")
        group = c["mixing_group_id"] if strategy == "custom" else i if strategy == "no_mixing" else 0
        total, each, rounds = batch_sizes(world_size, c.get("batch_size"), c.get("batch_gpu"), c.get("num_accum_rounds"))
        out.append(StreamOptions(name, ratio, group, total, each, rounds, c.get("is_main", False), dict(c.get("dataloader_kwargs", {}))))
    return out


def active(streams: Sequence[StreamOptions]) -> list[StreamOptions]:
    return [s for s in streams if s.ratio > 0]


def main_stream(streams: Sequence[StreamOptions]) -> StreamOptions:
    """The one marked as main or else the one of the largest ratio, among those in use."""
    used = active(streams)
    return next((s for s in used if s.is_main), max(used, key=lambda s: s.ratio))


def mixing_groups(streams: Sequence[StreamOptions], precision: int = 6) -> tuple[dict[int, int], dict[int, float]]:
    """Counts per meta-iteration and ratio of each group."""
    ratios: dict[int, float] = {}
    for s in active(streams):
        ratios[s.mixing_group_id] = ratios.get(s.mixing_group_id, 0.0) + s.ratio
    return dict(zip(ratios, ratios_to_counts(list(ratios.values()), precision=precision), strict=True)), ratios


def worker_counts(streams: Sequence[StreamOptions], workers: int, reweight: bool = True) -> dict[str, int]:
    used = active(streams)
    if not workers:
        return {s.name: 0 for s in used}
    if workers < len(used):
        raise ValueError(f"{workers} workers are fewer than {len(used)} streams")
    total = sum(s.ratio for s in used)
    return dict(zip([s.name for s in used], share_workers([s.ratio / total if reweight else 1 / len(used) for s in used], workers), strict=True))


def meta_order(counts: Mapping[int, int], interleaved: bool = False) -> list[int]:
    """Groups of one meta-iteration in order: 0 0 1 1 1 or, interleaved, 0 1 0 1 1."""
    if not interleaved:
        return [g for g, n in counts.items() for _ in range(n)]
    return [g for turn in range(max(counts.values(), default=0)) for g, n in counts.items() if n > turn]


def schedule(spark: SparkSession, steps: int, kind: str, counts: Mapping[int, int], ratios: Mapping[int, float] | None = None, seed: int = 42, start: int = 0) -> DataFrame:
    """(step, group) for steps start to start + steps - 1."""
    if kind not in SCHEDULES:
        raise ValueError(f"schedule must be one of {SCHEDULES}")
    base = spark.range(start, start + steps).select(F.col("id").alias("step"))
    if kind == "random":
        if not ratios:
            raise ValueError("a random schedule needs ratios")
        pick = weighted_pick(hash_uniform(F.lit(str(seed)), F.col("step")), [F.lit(float(r)) for r in ratios.values()])
        return base.select("step", F.get(F.array(*[F.lit(g) for g in ratios]), pick).alias("group"))
    order = meta_order(counts, kind == "consecutive_interleaved")
    size = len(order)
    if not size:
        raise ValueError("all counts are zero")
    place = (F.col("step") % size).cast("int")
    if kind in ("consecutive", "consecutive_interleaved"):
        return base.select("step", F.get(F.array(*[F.lit(g) for g in order]), place).alias("group"))
    # each meta-iteration's members are sorted by a hash of (seed, turn, member) inside its own row
    turn = F.col("meta") if kind == "random_order" else F.lit(0)
    members = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), turn.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))
    shuffled_ = F.transform(F.array_sort(members), lambda m: m["i"])
    metas = spark.range(start // size, (start + steps - 1) // size + 1).select(F.col("id").alias("meta"))
    slots = metas.select("meta", F.posexplode(shuffled_).alias("place", "member"))
    step = F.col("meta") * size + F.col("place")
    return slots.select(step.alias("step"), F.get(F.array(*[F.lit(g) for g in order]), F.col("member")).alias("group")).where((F.col("step") >= start) & (F.col("step") < start + steps))


def pick_streams(steps: DataFrame, streams: Sequence[StreamOptions], seed: int = 42, rank: int = 0) -> DataFrame:
    """Adds `stream`: drawn within the step's group by ratio, fixed by seed, rank and step."""
    out: Column = F.lit(None).cast("string")
    u = hash_uniform(F.lit(f"{seed}-{rank}"), F.col("step"))
    for group in {s.mixing_group_id for s in active(streams)}:
        mine = [s for s in active(streams) if s.mixing_group_id == group]
        names = F.array(*[F.lit(s.name) for s in mine])
        out = F.when(F.col("group") == group, F.get(names, weighted_pick(u, [F.lit(s.ratio) for s in mine]))).otherwise(out)
    return steps.withColumn("stream", out)


def groups_before(kind: str, counts: Mapping[int, int], step: int, seed: int = 42) -> dict[int, int] | None:
    """Steps of each group before a step, in closed form: whole meta-iterations times the counts, and a part of one. None for the random schedule, which has none."""
    if kind == "random":
        return None
    size = sum(counts.values())
    whole, part = divmod(step, size)
    order = meta_order(counts, kind == "consecutive_interleaved")
    if kind in ("random_order", "fixed_random_order"):
        turn = whole if kind == "random_order" else 0
        order = [order[i] for i in sorted(range(size), key=lambda i: (hashlib.md5(f"{seed}-{turn}-{i}".encode()).hexdigest(), i))]
    return {g: n * whole + order[:part].count(g) for g, n in counts.items()}


def uses_before(spark: SparkSession, streams: Sequence[StreamOptions], step: int, kind: str, counts: Mapping[int, int], ratios: Mapping[int, float] | None = None, seed: int = 42, rank: int = 0) -> dict[str, int]:
    """Batches of each stream before a step, without replaying the schedule: a group of one stream has its group's count; what a draw decides is counted by tasks, one sum per stream."""
    rounds = {s.name: s.num_accum_rounds for s in active(streams)}
    members: dict[int, list[StreamOptions]] = {}
    for s in active(streams):
        members.setdefault(s.mixing_group_id, []).append(s)
    closed = groups_before(kind, counts, step, seed)
    out = dict.fromkeys(rounds, 0)
    if closed is not None:
        out |= {m[0].name: closed[g] * rounds[m[0].name] for g, m in members.items() if len(m) == 1}
    drawn = [g for g, m in members.items() if closed is None or len(m) > 1]
    if drawn and step:
        steps = schedule(spark, step, kind, counts, ratios, seed).where(F.col("group").isin(drawn))
        out |= {r.stream: r.n * rounds[r.stream] for r in pick_streams(steps, streams, seed, rank).groupBy("stream").agg(F.count("*").alias("n")).collect()}
    return out


def accumulate(steps: DataFrame, streams: Sequence[StreamOptions], before: Mapping[str, int] | None = None) -> DataFrame:
    """One row per batch: a step of R rounds gives R of them, with R - 1 to 0 rounds left, and `use`, the stream's running batch number, on from `before`.

    Batch numbers are a running count per stream over the schedule, which has one row per step and
    no payload; it is summed in ranges of steps, so no window spans a whole stream.
    """
    from .cache import prefix_sums

    rounds: Column = F.lit(None).cast("int")
    for s in active(streams):
        rounds = F.when(F.col("stream") == s.name, F.lit(s.num_accum_rounds)).otherwise(rounds)
    counted = prefix_sums(steps.withColumn("_rounds", rounds).withColumn("_chunk", F.floor(F.col("step") / 100_000)), "_chunk", "step", "_rounds", ["stream"], "_upto").drop("_chunk")
    for name, n in (before or {}).items():
        counted = counted.withColumn("_upto", F.when(F.col("stream") == name, F.col("_upto") + n).otherwise(F.col("_upto")))
    rows = counted.where("_rounds > 0").withColumn("_left", F.explode(F.sequence(F.lit(0), F.col("_rounds") - 1)))
    return rows.select("step", "group", "stream", (F.col("_rounds") - 1 - F.col("_left")).alias("rounds_left"), (F.col("_upto") - F.col("_rounds") + F.col("_left")).cast("long").alias("use"))


def batches(df: DataFrame, place: str, size: int, stream: str, drop_last: bool = True) -> DataFrame:
    """Adds stream, batch_no, slot and n_batches to rows numbered from 0; an incomplete last batch is left out, unless it is kept."""
    n = df.agg(F.count("*")).first()[0]
    total = n // size if drop_last else -(-n // size)
    numbered = df.withColumn("stream", F.lit(stream)).withColumn("batch_no", F.floor(F.col(place) / size).cast("long")).withColumn("slot", (F.col(place) % size).cast("int")).withColumn("n_batches", F.lit(total).cast("long"))
    return numbered.where(F.col("batch_no") < total)


def mix(scheduled: DataFrame, streams: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every scheduled batch, from streams with batch columns; a stream that is exhausted starts again. Streams' own columns come aligned by name."""
    rows = None
    for df in streams.values():
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    assert rows is not None, "no streams"
    sizes = rows.select("stream", "n_batches").distinct()
    uses = scheduled.join(sizes, "stream").withColumn("batch_no", F.col("use") % F.col("n_batches")).drop("n_batches")
    return uses.join(rows.drop("n_batches"), ["stream", "batch_no"])


def stream_counts(scheduled: DataFrame) -> DataFrame:
    return scheduled.groupBy("stream").agg(F.count("*").alias("n"))


