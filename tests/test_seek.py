"""Approximate seeking and resumed mixing."""

import random

import pytest

from lodestream.operators import mixing, nearest


def nearest_of(t, frames, buffer):
    near = [(abs(p - t), p, f) for p, f in frames if p is not None and abs(p - t) <= buffer]
    return min(near)[2] if near else None


@pytest.mark.parametrize("cell", [0.11, 0.5, 60.0])
def test_merge_frames(spark, cell):
    """Uneven frames, gaps, equal times, requests before, between and after, one clip with most rows, negative times and nulls."""
    r = random.Random(9)
    frames = [(c, c * 10_000 + i, round(r.uniform(-1, 30 if c == 0 else 3), 2)) for c in range(4) for i in range(700 if c == 0 else 25)] + [(0, 1, None), (None, 2, 0.5), (1, 5, 1.0), (1, 4, 1.0)]
    asked = [(i, r.choice([0, 0, 0, 1, 2, 3, 7]), round(r.uniform(-2, 31), 3)) for i in range(800)] + [(900, 1, 1.0), (901, None, 0.5), (902, 1, None)]
    got = {x.i: x.frame for x in nearest.merge_frames(spark.createDataFrame(asked, "i int, c int, t double"), spark.createDataFrame(frames, "c int, f int, p double"), "c", "i", "t", "f", "p", strict=False, cell=cell).collect()}
    by = {}
    for c, f, p in frames:
        by.setdefault(c, []).append((p, f))
    assert got == {i: None if c is None or t is None else nearest_of(t, by.get(c, []), nearest.BUFFER_S) for i, c, t in asked}
    with pytest.raises(Exception, match="no frame near request"):
        nearest.merge_frames(spark.createDataFrame(asked, "i int, c int, t double"), spark.createDataFrame(frames, "c int, f int, p double"), "c", "i", "t", "f", "p").collect()


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "i int, c int, t double")
    plan = nearest.merge_frames(df, df.toDF("f", "c", "p"), "c", "i", "t", "f", "p", strict=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Window" in plan


@pytest.mark.parametrize("kind", mixing.SCHEDULES)
@pytest.mark.parametrize("step", [0, 1, 8, 137])
def test_resume_skips_ahead(spark, kind, step):
    """What is counted before a step equals a replay, whatever the schedule; closed forms need no job where no draw decides."""
    streams = mixing.stream_group([{"name": n, "ratio": q, "batch_size": 8, "num_accum_rounds": 2 if n == "b" else 1, "batch_gpu": 4 if n == "b" else 8, "mixing_group_id": g} for n, q, g in (("a", 3, 0), ("b", 2, 0), ("c", 2, 1), ("d", 1, 2))], strategy="custom")
    counts, ratios = mixing.mixing_groups(streams)
    plan = lambda n, start: mixing.pick_streams(mixing.schedule(spark, n, kind, counts, ratios, 7, start), streams, 7)
    whole = sorted(tuple(r) for r in mixing.accumulate(plan(step + 30, 0), streams).where(f"step >= {step}").collect())
    before = mixing.uses_before(spark, streams, step, kind, counts, ratios, 7)
    assert sorted(tuple(r) for r in mixing.accumulate(plan(30, step), streams, before).collect()) == whole
    if kind != "random":
        closed = mixing.groups_before(kind, counts, 10**15, 7)
        assert sum(closed.values()) == 10**15 and all(abs(n / 10**15 - c / sum(counts.values())) < 1e-9 for n, c in zip(closed.values(), counts.values(), strict=True))
