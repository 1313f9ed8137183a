"""Chains of transforms, one-to-many transforms and user functions.

A transform is any `DataFrame -> DataFrame`. Native ones are column expressions; `per_batch` takes
a function on pandas batches, `per_row` any function on one row's dict that returns a dict, a list
of dicts or a generator of them, run over Arrow batches.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ON_ERROR = ("fail", "skip", "quarantine")


class Transform(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def chain(df: DataFrame, transforms: Iterable[Transform]) -> DataFrame:
    for t in transforms:
        df = df.transform(t)
    return df


class Registry:
    """Named transforms, so that pipelines can be written in a config."""

    def __init__(self):
        self._made: dict[str, Callable[..., Transform]] = {}

    def register(self, name: str, make: Callable[..., Transform]) -> None:
        if name in self._made:
            raise ValueError(f"{name!r} is registered already")
        self._made[name] = make

    def build(self, steps: Iterable[Mapping[str, Any]]) -> list[Transform]:
        return [self._made[s["name"]](**{k: v for k, v in s.items() if k != "name"}) for s in steps]

    def __contains__(self, name: str) -> bool:
        return name in self._made


def per_batch(function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> Transform:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return lambda df: df.mapInPandas(run, schema)


def fan_out(made: Any) -> Iterator[dict]:
    """Dicts from a dict, a list or tuple, a generator or None, depth first."""
    if made is None:
        return
    if isinstance(made, Mapping):
        yield dict(made)
        return
    for x in made:
        yield from fan_out(x)


def per_row(function: Callable[[dict], Any], schema: str | T.StructType, on_error: str = "fail", first_only: bool = False) -> Transform:
    """Any function of one row. on_error: "fail"; "skip" drops the row; "quarantine" keeps it with null outputs and its error in `_error`."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()
    if on_error == "quarantine":
        schema = T.StructType([*schema.fields, T.StructField("_error", T.StringType())])

    def one(row: dict) -> list[dict]:
        try:
            out = []
            for made in fan_out(function(row)):
                out.append({n: made.get(n) for n in names})
                if first_only:
                    break
            return out
        except Exception:
            if on_error == "fail":
                raise
            return [] if on_error == "skip" else [dict.fromkeys(names) | {"_error": traceback.format_exc(limit=1)}]

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for row in batch.to_pylist() for x in one(row)], schema=arrow)

    return lambda df: df.mapInArrow(run, schema)


def explode_parts(column: str, parts: Callable[[Column], Column], output: str, position: str | None = None) -> Transform:
    """A one-to-many transform that can be written as an array expression; stays native."""

    def run(df: DataFrame) -> DataFrame:
        made = parts(F.col(column))
        return df.select("*", F.posexplode(made).alias(position, output)) if position else df.withColumn(output, F.explode(made))

    return run


def random_pair(column: str, output: str, key: str, seed: int) -> Transform:
    """Two different members of an array, fixed by the row's key; rows with fewer than two are dropped."""

    def run(df: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.transform(F.col(column), lambda x, i: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"), x.alias("x"))))
        return df.where(F.size(column) >= 2).withColumn(output, F.transform(F.slice(ranked, 1, 2), lambda r: r["x"]))

    return run


def split_words_udtf(spark: SparkSession, name: str = "split_words") -> None:
    """Registers a table function for SQL: one row per word of a text, with its place."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="place int, word string")
    class SplitWords:
        def eval(self, text: str):
            yield from enumerate((text or "").split())

    spark.udtf.register(name, SplitWords)


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A temporary SQL function; Catalyst inlines it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def table_function(spark: SparkSession, name: str, generator: Callable[..., Iterable[tuple]], schema: str) -> None:
    """Registers a user's generator as a table function: SQL calls it by name, for each row after LATERAL; it gets the arguments' values and yields rows of the schema."""

    class Function:
        def eval(self, *arguments: Any) -> Iterator[tuple]:
            yield from generator(*arguments)

    spark.udtf.register(name, F.udtf(Function, returnType=schema))
