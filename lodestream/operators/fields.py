"""Transforms of fields: select, rename, constants, gather, extract, merge, encode, cast, ensure."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..sources.files import read_bytes


class FieldError(ValueError):
    """A field that must be present is absent, or the other way round."""


def check_fields(df: DataFrame, present: Sequence[str] | Mapping[str, str] = (), absent: Sequence[str] = ()) -> DataFrame:
    """Checks presence, absence and, with a mapping, types when the plan is built, before any job."""
    types = dict(df.dtypes)
    for name in present:
        if name not in types:
            raise FieldError(f"field {name!r} is absent; there are {df.columns}")
        if isinstance(present, Mapping) and types[name] != present[name]:
            raise FieldError(f"field {name!r} is {types[name]}, not {present[name]}")
    for name in absent:
        if name in types:
            raise FieldError(f"field {name!r} is there already")
    return df


def filter_fields(df: DataFrame, keep: Sequence[str] | None = None, remove: Sequence[str] = ()) -> DataFrame:
    """Removes, then keeps; absent names are ignored."""
    df = df.drop(*remove)
    return df if keep is None else df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(keep)])


def ensure_fields(df: DataFrame, required: Sequence[str] | Mapping[str, str], drop_dummies: bool = False, drop_others: bool = False) -> DataFrame:
    check_fields(df, required)
    if drop_dummies:
        for name in required:
            df = df.where(~values.is_dummy(df, name))
    return filter_fields(df, list(required)) if drop_others else df


def required_columns(df: DataFrame, columns: Sequence[str], allow_missing: bool = False) -> DataFrame:
    """Rows with all the columns or, leniently, with one of them at least."""
    if not columns:
        raise FieldError("name at least one column")
    missing = [values.is_missing(df, c) for c in columns]
    test = F.lit(True)
    if allow_missing:
        test = F.lit(False)
        for m in missing:
            test = test | ~m
    else:
        for m in missing:
            test = test & ~m
    return df.where(test)


def rename_fields(df: DataFrame, mapping: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Renames one after the other; a target that exists is overwritten."""
    for old, new in mapping.items():
        if old not in df.columns:
            if strict:
                raise FieldError(f"no field {old!r} to rename")
            continue
        if old != new:
            df = df.drop(new).withColumnRenamed(old, new)
    return df


def add_constants(df: DataFrame, **constants: Any) -> DataFrame:
    check_fields(df, absent=list(constants))
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()})


def first_real_field(df: DataFrame, inputs: Sequence[str], output: str, strict: bool = True) -> DataFrame:
    return df.withColumn(output, values.first_real(df, inputs, strict))


def gather_fields(df: DataFrame, inputs: Sequence[str], output: str, kind: str = "dict") -> DataFrame:
    """A struct ("dict"), an array ("list") or a map of the fields."""
    check_fields(df, inputs)
    columns = [F.col(f"`{c}`") for c in inputs]
    if kind == "dict":
        made = F.struct(*[c.alias(n) for c, n in zip(columns, inputs, strict=True)])
    elif kind == "list":
        made = F.array(*columns)
    elif kind == "map":
        made = F.create_map(*[x for c, n in zip(columns, inputs, strict=True) for x in (F.lit(n), c)])
    else:
        raise ValueError(f"kind must be dict, list or map, not {kind!r}")
    return df.withColumn(output, made)


def extract_subfield(df: DataFrame, source: str, path: str, output: str) -> DataFrame:
    """A dotted path inside a struct, map or variant."""
    check_fields(df, [source], [output])
    kind = df.schema[source].dataType
    if isinstance(kind, T.VariantType):
        return df.withColumn(output, F.try_variant_get(F.col(source), f"$.{path}", "string"))
    column = F.col(f"`{source}`")
    for part in path.split("."):
        column = column[part]
    return df.withColumn(output, column)


def parse_json(df: DataFrame, source: str, output: str, schema: str | T.DataType | None = None) -> DataFrame:
    """JSON in a string or bytes as a struct or, without a schema, as a variant; unreadable text gives null."""
    text = F.col(f"`{source}`").cast("string")
    return df.withColumn(output, F.from_json(text, schema) if schema is not None else F.try_parse_json(text))


def merge_struct(df: DataFrame, source: str, on_conflict: str = "error", cleanup: bool = True) -> DataFrame:
    """A struct's fields as columns. on_conflict: "error", "skip" (keep the column) or "overwrite"."""
    names = df.schema[source].dataType.fieldNames()
    clash = [n for n in names if n in df.columns and n != source]
    if clash and on_conflict == "error":
        raise FieldError(f"fields are there already: {clash}")
    take = [n for n in names if not (on_conflict == "skip" and n in clash)]
    base = [F.col(f"`{c}`") for c in df.columns if not (cleanup and c == source) and c not in set(take) - {source} or c in clash and on_conflict == "skip"]
    return df.select(*base, *[F.col(f"`{source}`")[n].alias(n) for n in take])


def encode_classes(df: DataFrame, source: str, output: str, classes: Sequence[str] | DataFrame | Callable[[Column], Column], strict: bool = True) -> DataFrame:
    """Class names to ids: a short list inline, a table (name, id) by join, which Spark broadcasts only while it is small, or a function from column to column (a built-in expression or a pandas UDF)."""
    if callable(classes):
        found = classes(F.col(f"`{source}`"))
        unknown = F.raise_error(F.concat(F.lit("unknown class "), F.col(f"`{source}`").cast("string")))
        return df.withColumn(output, F.coalesce(found, unknown) if strict else found)
    if not isinstance(classes, DataFrame):
        return df.withColumn(output, values.encode(F.col(f"`{source}`"), classes, strict))
    table = classes.select(F.col("name").alias("_name"), F.col("id").alias(output))
    out = df.join(table, F.col(f"`{source}`") == F.col("_name"), "left").drop("_name")
    if not strict:
        return out
    return out.withColumn(output, F.coalesce(output, F.raise_error(F.concat(F.lit("unknown class "), F.col(f"`{source}`")))))


def one_hot_field(df: DataFrame, source: str, output: str, n: int) -> DataFrame:
    return df.withColumn(output, values.one_hot(F.col(f"`{source}`"), n))


def cast_fields(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({k: F.col(f"`{k}`").cast(v) for k, v in types.items()})


def choose_field(df: DataFrame, weights: Mapping[str, float], output: str, key: str, seed: int, paired: Mapping[str, Mapping[str, str]] | None = None, cleanup: bool = False) -> DataFrame:
    """One of several fields that is no dummy, drawn by weight and fixed by the row's key; `paired` outputs follow the same draw."""
    names = list(weights)
    shares = [F.when(~values.is_dummy(df, n), F.lit(float(weights[n]))).otherwise(0.0) for n in names]
    pick = values.weighted_pick(values.hash_uniform(F.lit(str(seed)), F.col(key)), shares)

    def chosen(columns: Sequence[str]) -> Column:
        out = F.lit(None)
        for i, c in enumerate(columns):
            if c in df.columns:
                out = F.when(F.col("_pick") == i, F.col(f"`{c}`")).otherwise(out)
        return out

    made = {output: chosen(names), f"{output}_source": F.get(F.array(*[F.lit(n) for n in names]), F.col("_pick"))}
    made |= {name: chosen([of[n] for n in names]) for name, of in (paired or {}).items()}
    out = df.withColumn("_pick", pick).withColumns(made).drop("_pick")
    return out.drop(*names, *[c for of in (paired or {}).values() for c in of.values()]) if cleanup else out


def none_to_empty(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def identity(df: DataFrame) -> DataFrame:
    return df


def load_files(df: DataFrame, column: str, output: str, text: bool = False) -> DataFrame:
    """Contents of the files that a column names, as bytes or text; null where there is no such file.

    Each row's file is fetched by the task that holds the row, so only named files are read and no
    list of paths reaches the driver. Paths are URLs of any scheme that `sources.files` opens, or local
    ones on a file system that all executors share; a row's file must fit its worker's memory.
    """
    kind = "string" if text else "binary"

    @F.pandas_udf(kind)
    def contents(paths: pd.Series) -> pd.Series:
        def one(path: str | None) -> str | bytes | None:
            try:
                data = read_bytes(path) if path else None
            except FileNotFoundError:
                return None
            return data.decode("utf-8", "replace") if text and data is not None else data

        return paths.map(one)

    return df.withColumn(output, contents(F.col(f"`{column}`")))
