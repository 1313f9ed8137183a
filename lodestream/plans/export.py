"""Building an index offline from a query: config, query, validation split, two writes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

from ..sources.sinks import save_csv, save_with_validation
from ..sources.resolver import resolve
from .dialect import to_spark


@dataclass(frozen=True)
class ExportConfig:
    sql_query: str
    destination: str
    keys: tuple[str, ...]
    val_ratio: float = 0.0
    max_num_val_rows: int | None = None
    recompute: bool = True
    row_group_bytes: int = 8 << 20
    seed: int = 42

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> ExportConfig:
        """Unknown and missing keys are errors."""
        known = {f.name for f in fields(cls)}
        if set(raw) - known:
            raise ValueError(f"unknown config keys {sorted(set(raw) - known)}")
        return cls(**{**raw, "keys": tuple(raw["keys"])})


def export(spark: SparkSession, config: ExportConfig) -> tuple[int, int]:
    """Runs the query over the session's views and writes the index and its validation part; returns their row counts."""
    df = spark.sql(to_spark(config.sql_query))
    return save_with_validation(df, config.destination, config.keys, config.val_ratio, config.max_num_val_rows, config.seed, config.recompute, config.row_group_bytes)


def export_source(spark: SparkSession, src: str, dst: str, data_type: str | None = None) -> None:
    """A source's whole index as one CSV."""
    save_csv(resolve(spark, src, data_type), dst, single=True)
