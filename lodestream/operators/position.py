"""Global row positions, slices and balanced bounds.

A Spark table has no order. The position of a row is its place when the files are read in order of
their paths: the rows of the files before its own plus its row index in the file. Counts per file
come from one aggregation over row indices alone, so no row is sorted and nothing passes through a
single task but one row per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import rowgroups
from ..sources.rowgroups import POS, file_counts, offsets

#: Rows that one task takes of a table dealt by chunk. Up to 240 million rows that is 200 partitions at most, which Spark's shuffle writes without holding rows.
CHUNKED_ROWS = 1_200_000


def with_position(df: DataFrame, column: str = POS) -> DataFrame:
    """Adds the global position to a Parquet table. The offsets are broadcast (one row per file, less than Spark's own list of files): a shuffle by file would bring each file's rows into one task."""
    start = offsets(file_counts(df)).select(F.col("file").alias("_file"), "start")
    numbered = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return numbered.join(F.broadcast(start), "_file").withColumn(column, F.col("start") + F.col("_row")).drop("_file", "_row", "start")


def by_chunk(df: DataFrame, chunk: int, n: int, position: str = POS, column: str = "_chunk") -> DataFrame:
    """Adds the chunk of `chunk` positions that a row of n is in, and deals the rows by chunk: windows and groups of a chunk then sort `CHUNKED_ROWS` rows a task, not those of a whole file split or row group."""
    tasks = max(rowgroups._tasks(df), -(-n // CHUNKED_ROWS))  # a number that is asked for: adaptive execution would join partitions again
    return df.withColumn(column, F.floor(F.col(position) / chunk)).repartition(tasks, column)


def slice_scan(df: DataFrame, start: int, end: int, step: int = 1, position: str = POS) -> DataFrame:
    """Rows at start, start + step, ... before end."""
    if step < 1:
        raise ValueError("step must be positive")
    inside = (F.col(position) >= start) & (F.col(position) < end)
    return df.where(inside & ((F.col(position) - start) % step == 0) if step > 1 else inside)


def take_positions(df: DataFrame, wanted: DataFrame, position: str = POS) -> DataFrame:
    """Rows at the wanted positions (column `position`), in one job for any number of them."""
    return df.join(wanted.select(F.col(position)), position)


def scan_slice(df: DataFrame, start: int, end: int, step: int = 1, position: str = POS) -> DataFrame:
    """Rows at start, start + step, ... before end of a table read from files, with their position. Only the row groups that the slice touches are read, in any number of files."""
    if step < 1:
        raise ValueError("step must be positive")
    if not rowgroups.readable(df):
        return slice_scan(with_position(df, position), start, end, step, position)
    touched = offsets(file_counts(df)).where((F.col("start") < end) & (F.col("start") + F.col("n") > start))
    tasks = max(1, -(-(end - start) // rowgroups.ROWS_PER_TASK))
    found = rowgroups.read(rowgroups.slice_pieces(rowgroups.footers(touched, tasks), start, end, step), df.schema, tasks)
    return found.drop(rowgroups.TAG).withColumnRenamed(POS, position)


def scan_rows(df: DataFrame, wanted: Sequence[int], position: str = POS) -> DataFrame:
    """Rows at the wanted positions of a table read from files, each once. Only row groups that hold one are read."""
    wanted = sorted({int(p) for p in wanted})
    if not rowgroups.readable(df):
        return with_position(df, position).where(F.col(position).isin(wanted))
    asked = F.array(*[F.lit(p) for p in wanted]).cast("array<bigint>")
    inside = lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n"))
    touched = offsets(file_counts(df)).where(F.exists(asked, inside))
    groups = rowgroups.footers(touched, min(len(wanted), rowgroups._tasks(df)) or 1).withColumn("_at", F.filter(asked, inside)).where(F.size("_at") > 0)
    pieces = F.transform("_at", lambda p: rowgroups._piece(p, p + 1)).alias("pieces")
    found = rowgroups.read(groups.select("file", "grp", "start", pieces), df.schema, min(len(wanted), rowgroups._tasks(df)) or 1)
    return found.drop(rowgroups.TAG).withColumnRenamed(POS, position)


def rank_bounds(n: int, rank: int, ranks: int, nodes: int = 1, interleaved: bool = False, within_node: bool = False, tail: str = "drop") -> tuple[int, int, int]:
    """(start, end, step) of one consumer. `within_node`: every node has an index of its own. tail: "drop" leaves n % ranks rows unread, "balance" gives them to the first consumers."""
    if within_node:
        rank, ranks = rank % (ranks // nodes), ranks // nodes
    if not 0 <= rank < ranks:
        raise ValueError(f"rank {rank} is not among {ranks}")
    if tail == "balance":
        if interleaved:
            return rank, n, ranks
        each, rest = divmod(n, ranks)
        start = rank * each + min(rank, rest)
        return start, start + each + (rank < rest), 1
    each = n // ranks
    return (rank, min(n, each * ranks), ranks) if interleaved else (rank * each, min(n, (rank + 1) * each), 1)


def rank_of(position: Column, n: int, ranks: int, interleaved: bool = False) -> Column:
    """The consumer that a row belongs to; null for the tail."""
    each = n // ranks
    rank = position % ranks if interleaved else F.floor(position / max(each, 1))
    return F.when(position < each * ranks, rank.cast("long"))


def balanced_bounds(counts: DataFrame, consumers: int, key: str = "key", n: str = "n") -> DataFrame:
    """(node, key, start, end): each consumer's part of each file when all rows are shared out evenly. (0, 0) is nothing."""
    spans = offsets(counts, key, n).select(F.col(key).alias("key"), F.col(n).cast("long").alias("n"), "start")
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total"))
    nodes = counts.sparkSession.range(consumers).select(F.col("id").alias("node")).crossJoin(F.broadcast(total))  # one row of totals
    each, rest = F.floor(F.col("total") / consumers), F.col("total") % consumers
    first = F.col("node") * each + F.least("node", rest)
    nodes = nodes.select("node", first.alias("lo"), (first + each + (F.col("node") < rest).cast("long")).alias("hi"))
    # every file meets every consumer in the result itself, as (0, 0) where they share no row
    both = nodes.crossJoin(spans)
    a, b = F.greatest("lo", "start"), F.least("hi", F.col("start") + F.col("n"))
    shared = a < b
    return both.select("node", "key", F.when(shared, a - F.col("start")).otherwise(0).alias("start"), F.when(shared, b - F.col("start")).otherwise(0).alias("end"))


def chunks(n: int, rank: int, ranks: int, chunk: int, tail: str = "drop") -> list[tuple[int, int]]:
    """(start, end) of a consumer's chunks. With "drop", chunks are equal and the consumer's rest is not read."""
    start, end, _ = rank_bounds(n, rank, ranks, tail=tail)
    size = end - start
    if not size:
        return []
    pieces = -(-size // chunk)
    if tail == "drop":
        each = size // pieces
        return [(start + i * each, start + (i + 1) * each) for i in range(pieces)]
    return [(start + i * size // pieces, start + (i + 1) * size // pieces) for i in range(pieces)]


def chunk_table(spark: SparkSession, n: int, ranks: int, chunk: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """(rank, chunk_id, start, end, place): every consumer's chunks in the order in which it reads them. Chunks are equal; what does not fill them is not read."""
    from .ordering import hash_order

    each = n // ranks
    pieces = -(-each // chunk) if each else 0
    size = each // pieces if pieces else 0
    df = spark.range(ranks * pieces).select(F.expr(f"id div {max(1, pieces)}").alias("rank"), (F.col("id") % max(1, pieces)).alias("chunk_id"))
    df = df.withColumn("start", F.col("rank") * each + F.col("chunk_id") * size).withColumn("end", F.col("start") + size)
    order = [F.col("chunk_id")] if seed is None else hash_order(seed, F.lit(epoch), F.col("rank"), F.col("chunk_id"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy(*order)) - 1)
