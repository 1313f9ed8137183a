"""Several sources mixed by a schedule."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators import mixing
from .index import StreamingSource, load_mixed_state, mixed_state


@dataclass
class MixedLoader:
    """Batches of several sources in the order of a schedule, for one consumer."""

    sources: Mapping[str, StreamingSource]
    streams: Sequence[mixing.StreamOptions]
    schedule: str = "fixed_random_order"
    seed: int = 42
    precision: int = 6
    step: int = 0

    def __post_init__(self):
        if {s.name for s in self.streams} != set(self.sources):
            raise ValueError("sources and streams must have the same names")
        self.counts, self.ratios = mixing.mixing_groups(self.streams, self.precision)

    def _spark(self) -> SparkSession:
        return next(iter(self.sources.values())).spark

    def steps(self, n: int, rank: int = 0) -> DataFrame:
        """(step, group, stream, rounds_left, use) of the next n steps. What each stream has used before is skipped, not replayed."""
        spark = self._spark()
        before = mixing.uses_before(spark, self.streams, self.step, self.schedule, self.counts, self.ratios, self.seed, rank)
        planned = mixing.schedule(spark, n, self.schedule, self.counts, self.ratios, self.seed, self.step)
        return mixing.accumulate(mixing.pick_streams(planned, self.streams, self.seed, rank), self.streams, before)

    def batches(self, n: int, rank: int = 0, ranks: int = 1) -> DataFrame:
        """Rows of the next n steps, with step, stream, rounds_left, batch and slot columns."""
        parts = {s.name: mixing.batches(self.sources[s.name].samples(rank, ranks), "place", s.batch_gpu, s.name) for s in mixing.active(self.streams)}
        return mixing.mix(self.steps(n, rank), parts)

    def iterate(self, n: int, rank: int = 0, ranks: int = 1) -> Iterator[tuple[dict[str, Any], list[Row]]]:
        """(step, stream, rounds_left) and rows of each batch, in order, on the driver."""
        head, held = None, []
        for row in self.batches(n, rank, ranks).orderBy("step", "use", "slot").toLocalIterator():
            now = {k: row[k] for k in ("step", "stream", "rounds_left")}
            if head is not None and now != head:
                yield head, held
                held = []
            head = now
            held.append(row)
        if head is not None:
            yield head, held
        self.step += n

    def state_dict(self) -> dict[str, Any]:
        return mixed_state(dict(self.sources), self.step)

    def load_state_dict(self, state: dict[str, Any]) -> None:
        self.step = load_mixed_state(dict(self.sources), state)
