"""Keys and extensions of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Last extension with its dot; a leading dot of the name does not start one."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def full_extension(path: Column) -> Column:
    """Everything from the first dot of the basename on."""
    return F.regexp_extract(basename(path), r"^[^.]*(\..*)$", 1)


def file_key(path: Column) -> Column:
    """Basename without its full extension."""
    return F.regexp_extract(basename(F.regexp_replace(path, "/+$", "")), r"^([^.]*)", 1)


def path_key(path: Column, num_parts: int = 2, drop_ext: bool = False) -> Column:
    """Scheme and the last `num_parts` parts (-1: all), joined by dashes."""
    if num_parts != -1 and num_parts < 1:
        raise ValueError("num_parts must be positive or -1")
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    parts = F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "/"), lambda p: p != "")
    if num_parts != -1:
        parts = F.slice(parts, F.greatest(F.size(parts) - num_parts + 1, F.lit(1)), F.lit(num_parts))
    key = F.array_join(parts, "-")
    if drop_ext:
        key = F.regexp_replace(key, r"(?<=[^.-])\.[^.]*$", "")
    return F.when(scheme != "", F.concat(F.lower(scheme), F.lit("-"), key)).otherwise(key)


def cache_path(dst: str, name: str, key: Column, column: str, url: Column) -> Column:
    """Where a sample's file is kept: <dst>/<name>/<key>-<column><extension in lower case>."""
    return F.concat(F.lit(f"{dst.rstrip('/')}/{name}/"), key.cast("string"), F.lit(f"-{column}"), F.lower(extension(url)))
