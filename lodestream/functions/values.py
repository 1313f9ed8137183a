"""Missing and dummy values, lookups and encodings, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing for a fetch: absent, null or an empty string. NaN is a value."""
    if name not in df.columns:
        return F.lit(True)
    c = F.col(f"`{name}`")
    return c.isNull() | (c == "") if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()


def is_dummy(df: DataFrame, name: str) -> Column:
    """A placeholder: absent, null, empty string, array or map, NaN, or an array with a NaN. Zero and False are values."""
    if name not in df.columns:
        return F.lit(True)
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    test = F.lit(False)
    if isinstance(kind, T.StringType | T.BinaryType):
        test = F.length(c) == 0
    elif isinstance(kind, T.FloatType | T.DoubleType):
        test = F.isnan(c)
    elif isinstance(kind, T.MapType):
        test = F.size(c) == 0
    elif isinstance(kind, T.ArrayType):
        test = F.size(c) == 0
        if isinstance(kind.elementType, T.FloatType | T.DoubleType):
            test = test | F.exists(c, lambda x: F.coalesce(F.isnan(x), F.lit(False)))
    return c.isNull() | F.coalesce(test, F.lit(False))


def first_real(df: DataFrame, names: Sequence[str], strict: bool = False) -> Column:
    """The first value that is no dummy; without one, null or, if strict, an error."""
    values = [F.when(~is_dummy(df, n), F.col(f"`{n}`")) for n in names if n in df.columns]
    if strict:
        values.append(F.raise_error(F.lit(f"no value in {', '.join(names)}")))
    return F.coalesce(*values)


def encode(value: Column, classes: Sequence[str], strict: bool = False) -> Column:
    """Position of a value in a list of classes; unknown ones give null or, if strict, an error."""
    code = F.lit(None).cast("int")
    table = F.array(*[F.lit(c) for c in classes])
    code = F.when(F.array_contains(table, value), (F.array_position(table, value) - 1).cast("int"))
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown class "), value))) if strict else code


def one_hot(label: Column, n: int) -> Column:
    """Array of n floats; a label outside [0, n) gives null."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("float"))
    return F.when((label >= 0) & (label < n), hot)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 8 hex digits of an md5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def weighted_pick(u: Column, weights: Sequence[Column]) -> Column:
    """0-based index of the weight in whose share u falls; weights need no normalising. Null if all are zero."""
    total = sum(weights[1:], weights[0])
    out, before = F.lit(None).cast("int"), F.lit(0.0)
    picks = []
    for i, w in enumerate(weights):
        before = before + w
        picks.append((i, before, w))
    for i, upto, w in reversed(picks):
        out = F.when((w > 0) & (u * total < upto), F.lit(i)).otherwise(out)
    return F.when(total > 0, out)


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 1024, 123b or 1.5kb (kb to eb, powers of 1024, any case); null stays null (no limit), anything else is an error."""
    low = F.lower(F.trim(text))
    units = ("kb", "mb", "gb", "tb", "pb", "eb")
    at = F.array_position(F.array(*[F.lit(u) for u in units]), F.right(low, F.lit(2))).cast("int") - 1
    power = F.get(F.array(*[F.lit(1024.0**i) for i in range(1, 7)]), at)
    whole, part = F.regexp_extract(low, r"^(\d+)b?$", 1), F.regexp_extract(low, r"^(\d+\.?\d*|\.\d+)\s*[kmgtpe]b$", 1)
    bad = F.raise_error(F.concat(F.lit("not a byte size: "), text)).cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).when(whole != "", whole.cast("long")).when(part != "", F.floor(part.cast("double") * power).cast("long")).otherwise(bad)


def ratios(df: DataFrame, size: str) -> DataFrame:
    """Adds each row's `ratio` of the whole and its `turns`: how often it counts if the smallest positive ratio counts once, halves to even. One row per stream."""
    whole = Window.partitionBy()
    told = df.withColumn("ratio", F.col(size) / F.sum(size).over(whole))
    least = F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).over(whole)
    return told.withColumn("turns", F.when(F.col("ratio") > 0, F.greatest(F.bround(F.col("ratio") / least), F.lit(1.0))).otherwise(0).cast("long"))
