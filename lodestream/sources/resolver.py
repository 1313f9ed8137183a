"""From a source string to an index table.

A source is a list file, a wildcard, a single index file or a folder, told apart by its name as
Spark's readers see it; every path goes through Hadoop's file systems, so any scheme that the
cluster has a connector for works.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

LIST_FILE = "split_file_paths.txt"
FORMATS = ("csv", "json", "parquet")
#: Extensions of each kind of sample; the latent kinds share one set.
_LATENT = (".pkl", ".pt", ".ckpt", ".npy", ".npz", ".h5", ".hdf5", ".safetensors")
EXTENSIONS = {
    "IMAGE": (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff"),
    "VIDEO": (".mp4", ".avi", ".mov", ".mkv", ".webm", ".m4v", ".mpg", ".mpeg", ".wmv", ".flv", ".3gp", ".3g2"),
    "AUDIO": (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac"),
    "TEXT": (".txt", ".json", ".csv", ".xml", ".md", ".html", ".pdf", ".docx", ".rtf"),
} | dict.fromkeys(("IMAGE_LATENT", "VIDEO_LATENT", "AUDIO_LATENT", "TEXT_LATENT"), _LATENT)


def data_type(name: str) -> str:
    kind = name.upper()
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown data type {name!r}; there are {sorted(EXTENSIONS)}")
    return kind


def type_of_extension(ext: str) -> str:
    """The first data type with this extension, with or without its dot, in any case."""
    ext = "." + ext.lower().lstrip(".")
    return next(k for k, v in EXTENSIONS.items() if ext in v)


def resolve(spark: SparkSession, src: str, kind: str | None = None, max_files: int | None = None, strict: bool = True, ignore_corrupt: bool = False) -> DataFrame:
    """The index table of a source."""
    if src.endswith(LIST_FILE) or "*" in src:
        return from_files(spark, list_files(spark, src), max_files, ignore_corrupt)
    if _format(src):
        return read_index(spark, [src], ignore_corrupt)
    if kind is None:
        raise ValueError("a folder needs a data type")
    return from_folder(spark, src, kind, strict)


def _format(path: str) -> str | None:
    ext = path.rsplit(".", 1)[-1]
    return ext if ext in FORMATS and "." in path.rsplit("/", 1)[-1] else None


def read_index(spark: SparkSession, files: Sequence[str], ignore_corrupt: bool = False) -> DataFrame:
    """CSV with a header, JSON arrays of records, or Parquet; one format at a time, columns aligned by name."""
    kinds = {_format(f) for f in files}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"files must have one format of {FORMATS}: {sorted(files)[:3]}")
    reader = spark.read.option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    kind = kinds.pop()
    if kind == "csv":
        return reader.csv(list(files), header=True, inferSchema=True)
    if kind == "json":
        return reader.json(list(files), multiLine=True)
    return reader.option("mergeSchema", "true").parquet(*files)


def list_files(spark: SparkSession, src: str) -> list[str]:
    """Sorted paths of a list file (blank lines dropped) or of a wildcard dir/*.ext, which searches below dir too."""
    if src.endswith(LIST_FILE):
        return sorted(r.value.strip() for r in spark.read.text(src).collect() if r.value.strip())
    folder, _, pattern = src.rpartition("/")
    found = re.fullmatch(r"\*\.(\w+)", pattern)
    if not found or "*" in folder or found[1] not in FORMATS:
        raise ValueError(f"a wildcard must be dir/*.ext with ext in {FORMATS}: {src!r}")
    return sorted(r.path for r in listing(spark, folder, [f".{found[1]}"]).select("path").collect())


def from_files(spark: SparkSession, files: Sequence[str], max_files: int | None = None, ignore_corrupt: bool = False) -> DataFrame:
    files = sorted(files)[:max_files]
    if not files:
        raise ValueError("no index files")
    return read_index(spark, files, ignore_corrupt)


def listing(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None, ignore: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder; contents are not read. `ignore` is a pattern that a whole relative path must match to be left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    if extensions:
        files = files.where(F.lower(paths.extension(F.col("path"))).isin([e.lower() for e in extensions]))
    if ignore:
        root = folder.split(":", 1)[-1].rstrip("/")
        relative = F.regexp_replace(F.regexp_replace(F.col("path"), r"^\w+:/*", "/"), "^" + re.escape("/" + root.lstrip("/")) + "/", "")
        files = files.where(~relative.rlike(f"^(?:{ignore})$"))
    return files


def files_to_index(files: DataFrame, kind: str, strict: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """From (path): one row per main file's key, one column per full extension, sorted by `index`.

    Main files have an extension of the data type; other files join by key. Two files of one key
    and extension are an error or, leniently, the larger path wins.
    """
    mains = [e.lower() for e in EXTENSIONS[data_type(kind)]]
    path = F.col("path")
    keyed = files.select(paths.file_key(path).alias("index"), F.lower(F.substring(paths.full_extension(path), 2, 1000)).alias("field"), path, F.lower(paths.extension(path)).isin(mains).alias("main"))
    keyed = keyed.join(keyed.where("main").select("index").distinct(), "index", "left_semi")
    cells = keyed.groupBy("index", "field").agg(F.max("path").alias("path"), F.count("*").alias("n"))
    if strict:
        cells = cells.withColumn("path", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several files for "), "index", F.lit("."), "field"))).otherwise(F.col("path")))
    pivot = cells.groupBy("index").pivot("field", list(columns)) if columns else cells.groupBy("index").pivot("field")
    return pivot.agg(F.max("path")).orderBy("index")


def from_folder(spark: SparkSession, folder: str, kind: str, strict: bool = True) -> DataFrame:
    return files_to_index(listing(spark, folder), kind, strict)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of all Parquet files below a path, from their footers."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).count()


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
