"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that go to a Python worker at once; rows of a shuffle's partition, which adaptive execution may join again.
BATCH_BYTES, PARTITION_ROWS = 8 << 20, 500_000
_own: list[str] = []


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that a worker's memory does not follow the length of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def batched_udf(kind) -> Callable:
    """A pandas UDF of long rows (pixels, sound, files): its batches are bounded by bytes, not only by rows."""
    bounded(SparkSession.active())
    return F.pandas_udf(kind)


def spread(spark: SparkSession, rows: int) -> None:
    """Lets the session's shuffles begin with a partition per `PARTITION_ROWS` rows, so that what a task sorts does not follow the input."""
    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get(setting, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if (wanted := -(-rows // PARTITION_ROWS)) > least:
        spark.conf.set(setting, wanted)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a temporary folder, in local mode only: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestream-"))
        found = _own[0]
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df there as Parquet and reads it again, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
