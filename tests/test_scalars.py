import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestream.functions import scalars
from lodestream.operators import mixing, ordering, position, splits


@pytest.mark.parametrize(("size", "value"), [(5, 5), (2.9, 2), ("123", 123), ("123b", 123), ("1kb", 1024), ("1.5 KB", 1536), ("2mb", 2 << 20), ("1yb", 1024**8), (None, None)])
def test_bytes(size, value):
    assert scalars.parse_bytes(size) == value


@pytest.mark.parametrize("size", ["", "kb", "1xb", "1.5", "-3", "one mb"])
def test_bad_bytes(size):
    with pytest.raises(ValueError):
        scalars.parse_bytes(size)


def test_ratios():
    assert scalars.normalize_ratios([None, None]) == [0.5, 0.5]
    assert scalars.normalize_ratios([1, 3, 0]) == [0.25, 0.75, 0]
    for bad in ([None, 1], [-1, 2], [0, 0]):
        with pytest.raises(ValueError):
            scalars.normalize_ratios(bad)
    assert scalars.ratios_to_counts([0.25, 0.375, 0.625]) == [1, 2, 2]  # 1.5 and 2.5 round to even
    assert scalars.ratios_to_counts([0.5, 0.0, 0.125]) == [4, 0, 1]
    assert scalars.ratios_to_counts([0.25] * 4) == [1] * 4
    assert scalars.ratios_to_counts([0, 0], min_count=3) == [3, 3]
    with pytest.raises(ValueError):
        scalars.ratios_to_counts([0.5, -0.5])


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=8), st.integers(1, 64))
def test_worker_shares_sum_up(raw, extra):
    ratios = scalars.normalize_ratios(raw)
    total = len(ratios) + extra
    shares = scalars.share_workers(ratios, total)
    assert sum(shares) == total and min(shares) >= 0


def test_batch_sizes():
    assert scalars.batch_sizes(4, batch_size=64) == (64, 16, 1)
    assert scalars.batch_sizes(4, batch_size=64, batch_gpu=4) == (64, 4, 4)
    assert scalars.batch_sizes(4, batch_gpu=4, rounds=3) == (48, 4, 3)
    assert scalars.batch_sizes(4, batch_size=0) == (0, 0, 0)
    for bad in ({"batch_size": 63}, {"batch_size": 64, "batch_gpu": 5}, {}):
        with pytest.raises(ValueError):
            scalars.batch_sizes(4, **bad)


@given(st.integers(0, 10**9), st.integers(1, 10**6))
def test_coprime(seed, n):
    a = scalars.coprime(seed, n)
    assert 0 <= a < n and math.gcd(a, n) == 1


def test_affine_is_a_bijection_and_splits_cover():
    for n, seed in ((100_000, 123), (10_000, 1337), (1, 5), (2, 0)):
        a, b = scalars.coprime(seed, n), scalars.offset(seed, n)
        assert len({(a * i + b) % n for i in range(n)}) == n
    ranges = [ordering.affine_split(10_003, 10, s) for s in range(10)]
    assert ranges[0] == (0, 1000) and ranges[-1] == (9000, 10_003)
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]]


def test_rank_bounds():
    assert [position.rank_bounds(100, r, 4)[:2] for r in range(4)] == [(0, 25), (25, 50), (50, 75), (75, 100)]
    assert position.rank_bounds(10, 2, 4, interleaved=True) == (2, 8, 4)
    assert position.rank_bounds(10, 5, 8, nodes=2, within_node=True) == (2, 4, 1)
    with pytest.raises(ValueError):
        position.rank_bounds(10, 4, 4)


@given(st.integers(0, 500), st.integers(1, 12), st.booleans(), st.sampled_from(["drop", "balance"]))
def test_slices_are_disjoint_and_cover(n, ranks, interleaved, tail):
    seen = [i for r in range(ranks) for i in range(*position.rank_bounds(n, r, ranks, interleaved=interleaved, tail=tail))]
    assert len(seen) == len(set(seen))
    assert len(seen) == (n if tail == "balance" else n // ranks * ranks)
    assert set(seen) == set(range(len(seen)))


def test_chunks():
    parts = position.chunks(1050, 0, 1, 100)
    assert len(parts) == 11 and all(b - a == 95 for a, b in parts)
    parts = position.chunks(1050, 0, 1, 100, tail="balance")
    assert parts[0][0] == 0 and parts[-1][1] == 1050 and all(b - a <= 100 for a, b in parts)
    assert position.chunks(3, 0, 4, 100) == []


def test_meta_orders():
    counts = {0: 2, 1: 3, 2: 4}
    assert mixing.meta_order(counts) == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert mixing.meta_order(counts, True) == [0, 1, 2, 0, 1, 2, 1, 2, 2]


def test_stream_options():
    made = mixing.stream_group([{"name": "a", "ratio": 1, "batch_size": 8}, {"ratio": 3, "batch_gpu": 2, "num_accum_rounds": 2}, {"ratio": 0, "batch_size": 4}], world_size=2)
    assert [(s.name, s.ratio, s.mixing_group_id, s.batch_size, s.num_accum_rounds) for s in made] == [("a", 0.25, 0, 8, 1), ("stream_001", 0.75, 1, 8, 2), ("stream_002", 0.0, 2, 4, 1)]
    assert mixing.main_stream(made).name == "stream_001"
    assert mixing.mixing_groups(made) == ({0: 1, 1: 3}, {0: 0.25, 1: 0.75})
    assert mixing.worker_counts(made, 4) == {"a": 1, "stream_001": 3}
    for bad, options in (([{"name": "a", "batch_size": 1}, {"name": "a", "batch_size": 1}], {}), ([{"batch_size": 1}], {"strategy": "custom"}), ([{"batch_size": 1}], {"strategy": "x"}), ([{"batch_size": 1, "speed": 2}], {}), ([{"mixing_group_id": 1, "batch_size": 1}] * 2, {})):
        with pytest.raises(ValueError):
            mixing.stream_group(bad, **options)
    with pytest.raises(ValueError):
        mixing.worker_counts(made, 1)


def test_validation_size():
    assert splits.validation_size(1000, 0.1, 60) == 60
    assert splits.validation_size(1000, 0.1) == 100
    with pytest.raises(ValueError):
        splits.validation_size(10, 0.6)
    assert scalars.whole_ratio(30, 10) == 3
    with pytest.raises(ValueError):
        scalars.whole_ratio(30, 20)
    assert scalars.ceil_to(65, 64) == 128
