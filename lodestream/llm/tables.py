"""Where the queries find their tables and where steps keep written tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of what goes to and from Python workers at once, and of what a Parquet writer holds back.
BATCH_ROWS, BATCH_BYTES, ROW_GROUP_BYTES = 2_000, 8 << 20, 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that a worker's memory follows neither the number nor the length of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where none is set, a temporary one, in local mode only: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lodestream-"))
    return _own_dir[0]


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def keep(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs only a read.

    Spark deletes the shuffle files of the write as soon as it has ended, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"):
        df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, label: str, by: str, n: int) -> DataFrame:
    """Like `keep`, in n buckets by a column: joins on it then move only the other side. The table is external and temporary; its name is dropped with the session."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"):
        df.write.format("parquet").option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP_BYTES).option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, by).saveAsTable(name)
    return spark.table(name)


def ends_shuffles(apply: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that run steps of their own: shuffle files of a step are deleted when it has ended. What the operator returns is run later, under the session's own setting."""

    @wraps(apply)
    def inside(docs: DataFrame, *a: object, **b: object) -> DataFrame:
        with _set(docs.sparkSession, _CLEANUP, "true"):
            return apply(docs, *a, **b)

    return inside


def drop_kept(*frames: DataFrame) -> None:
    """Deletes tables that `keep` wrote."""
    for df in frames:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if shared_dir(spark).split(":")[-1].lstrip("/") not in parent:
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy() -> None:
    """At the end of a task: gives memory that a reused Python worker no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
