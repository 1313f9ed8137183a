"""A map of Parquet row groups, and reads of just the groups that a request touches.

Spark's scan reads whole splits: it can skip files and, by statistics, row groups, but not rows by
their place. Here the place of every row group (file, group, first position, rows) is a table,
written by tasks that read footers only. A request becomes a set of pieces per group, a plain join or
filter of that table, and a task opens the groups that it was dealt and no others. Nothing is listed
on the driver, so neither the number of files nor that of groups matters, and one large file is read
by as many tasks as it has groups. Files are opened by Arrow's file systems (local, s3, gs, hdfs);
where a scheme has none, positions come from Spark's own scan of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import bounded, materialize

POS, TAG = "_pos", "_tag"
#: Rows that one task is asked to read, and rows that are decoded at once.
ROWS_PER_TASK, BATCH_ROWS = 250_000, 65_536
#: Positions of a group that one row of a request may hold.
BLOCK = 4096
_PIECES = "array<struct<lo:long,hi:long,step:long,tag:long>>"


def _open(path: str) -> pq.ParquetFile:
    fs, inside = pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)
    return pq.ParquetFile(inside, filesystem=fs, memory_map=isinstance(fs, pafs.LocalFileSystem))


def readable(df: DataFrame) -> bool:
    """Whether df is a table as it was read, or some of its columns, and Arrow has a file system for its files."""
    plan = df._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    if kind(plan) == "Project" and all(kind(plan.projectList().apply(i)) == "AttributeReference" for i in range(plan.projectList().size())):
        plan = plan.child()
    if kind(plan) != "LogicalRelation":
        return False
    one = df.select(F.col("_metadata.file_path").alias("file")).first()
    if one is None:
        return False
    try:
        pafs.FileSystem.from_uri(one.file)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def file_counts(df: DataFrame) -> DataFrame:
    """(file, n) of a table read from files."""
    return df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"))


def offsets(counts: DataFrame, key: str = "file", n: str = "n") -> DataFrame:
    """Adds `start`, the rows of all smaller keys. One row per file or chunk goes through the window, never a data row."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def footers(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file, grp, start, n): every row group of (file, start) with its first position, from footers alone."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, int, int, int]] = []
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with _open(file) as f:
                    sizes = [f.metadata.row_group(i).num_rows for i in range(f.metadata.num_row_groups)]
                at = start + np.cumsum([0, *sizes[:-1]]) if sizes else []
                rows += [(file, i, int(a), n) for i, (a, n) in enumerate(zip(at, sizes, strict=True)) if n]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["file", "grp", "start", "n"])

    return files.select("file", "start").repartition(tasks or _tasks(files), "file").mapInArrow(groups, "file string, grp long, start long, n long")


def read_group(arrow: pa.Schema, file: str, grp: int, start: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
    """The rows of a group's pieces in Arrow batches, with position and tag, on whatever machine this runs."""
    pieces = sorted(pieces, key=lambda p: p["lo"])
    lo, hi, step, tag = (np.array([p[k] for p in pieces], dtype=np.int64) for k in ("lo", "hi", "step", "tag"))
    with _open(file) as f:
        have = set(f.schema_arrow.names)
        at, last = start, int(hi.max())
        for batch in f.iter_batches(BATCH_ROWS, row_groups=[grp], columns=[n for n in arrow.names if n in have]):
            if at >= last:
                break
            end = at + batch.num_rows
            picked, tags = [], []
            for k in np.flatnonzero((lo < end) & (hi > at)):
                first = lo[k] if lo[k] >= at else lo[k] - (lo[k] - at) // step[k] * step[k]
                places = np.arange(first, min(hi[k], end), step[k])
                picked.append(places)
                tags.append(np.full(len(places), tag[k]))
            wanted = np.concatenate(picked) if picked else np.empty(0, dtype=np.int64)
            if len(wanted):
                taken = batch.take(pa.array(wanted - at))
                columns = [taken.column(c.name).cast(c.type) if c.name in have else _from_path(file, c, len(wanted)) for c in arrow]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(wanted), pa.array(np.concatenate(tags))], names=[*arrow.names, POS, TAG])
            at = end


def read(groups: DataFrame, schema: T.StructType, tasks: int) -> DataFrame:
    """The rows of every group's pieces, with their position and the piece's tag.

    A piece is lo, lo + step, ... before hi, in positions. A group is decoded once for all its
    pieces, in batches; columns that a file lacks are taken from its path (name=value) or are null.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield from read_group(arrow, r["file"], r["grp"], r["start"], r["pieces"])

    out = T.StructType([*schema.fields, T.StructField(POS, T.LongType()), T.StructField(TAG, T.LongType())])
    return groups.select("file", "grp", "start", F.col("pieces").cast(_PIECES).alias("pieces")).repartition(tasks, "file", "grp").mapInArrow(run, out)


def blocks(groups: DataFrame, asked: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(file, grp, start, block, at): the distinct positions `lo` within their group, at most `block` in a row, so that no row follows the size of a group."""
    there = groups.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width)))).select("start", "n", "_cell")
    both = there.join(asked.withColumn("_cell", F.floor(F.col("lo") / width)), "_cell").where((F.col("lo") >= F.col("start")) & (F.col("lo") < F.col("start") + F.col("n")))
    at = (F.col("lo") - F.col("start")).cast("int")
    found = both.groupBy("start", F.floor(at / block).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("at"))
    return found.join(groups.select("file", "grp", "start"), "start")


def read_blocks(asked: DataFrame, schema: T.StructType, tasks: int) -> DataFrame:
    """The rows of every group's blocks, with their position. A group's blocks arrive in order, so it is decoded once while they pass by."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, source, rows, batch, first = None, None, None, None, 0
        try:
            for b in batches:
                for i in range(b.num_rows):
                    file, grp, start, at = b.column("file")[i].as_py(), b.column("grp")[i].as_py(), b.column("start")[i].as_py(), b.column("at")[i].values.to_numpy()
                    if key != (file, grp):
                        if source is not None:
                            source.close()
                        key, source, batch, first = (file, grp), _open(file), None, 0
                        have = set(source.schema_arrow.names)
                        rows = source.iter_batches(BATCH_ROWS, row_groups=[grp], columns=[n for n in arrow.names if n in have])
                    while len(at):
                        while batch is None or at[0] >= first + batch.num_rows:
                            first += 0 if batch is None else batch.num_rows
                            batch = next(rows)
                        here = at[: np.searchsorted(at, first + batch.num_rows)]
                        at = at[len(here) :]
                        taken = batch.take(pa.array(here - first))
                        columns = [taken.column(c.name).cast(c.type) if c.name in have else _from_path(file, c, len(here)) for c in arrow]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(here.astype(np.int64) + start)], names=[*arrow.names, POS])
        finally:
            if source is not None:
                source.close()

    bounded(asked.sparkSession)
    dealt = asked.select("file", "grp", "start", "block", "at").repartition(tasks, "file", "grp").sortWithinPartitions("file", "grp", "block")
    return dealt.mapInArrow(run, T.StructType([*schema.fields, T.StructField(POS, T.LongType())]))


def _from_path(file: str, column: pa.Field, n: int) -> pa.Array:
    value = next((unquote(x.split("=", 1)[1]) for x in file.split("/") if x.startswith(f"{column.name}=")), None)
    return pa.array([None if value == "__HIVE_DEFAULT_PARTITION__" else value] * n, pa.string()).cast(column.type)


def _piece(lo: Column, hi: Column, step: int | Column = 1, tag: int | Column = 0) -> Column:
    as_long = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.struct(as_long(lo).alias("lo"), as_long(hi).alias("hi"), as_long(step).alias("step"), as_long(tag).alias("tag"))


def slice_pieces(groups: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    """The groups that hold start, start + step, ... before end, each with its piece of that."""
    first = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("start") - start) / step).cast("long") * step)
    found = groups.where((F.col("start") < end) & (F.col("start") + F.col("n") > start)).withColumn("_lo", first)
    stop = F.least(F.lit(end).cast("long"), F.col("start") + F.col("n"))
    return found.where(F.col("_lo") < stop).select("file", "grp", "start", F.array(_piece(F.col("_lo"), stop, step)).alias("pieces"))


def piece_join(groups: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The groups that (lo, hi, tag) touch, with their pieces: an equal join on cells of `width` positions, wherever both lie in a cell."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    there = groups.withColumn("_cell", cells(F.col("start"), F.col("start") + F.col("n")))
    asked = wanted.where("lo < hi").select("lo", "hi", "tag").withColumn("_cell", cells(F.col("lo"), F.col("hi")))
    lo, hi = F.greatest("lo", "start"), F.least("hi", F.col("start") + F.col("n"))
    # a pair that shares several cells counts in the cell where its common part begins
    both = there.join(asked, "_cell").where((lo < hi) & (F.floor(lo / width) == F.col("_cell")))
    return both.groupBy("file", "grp", "start").agg(F.collect_list(_piece(lo, hi, 1, F.col("tag"))).alias("pieces"))


def groups_of(table: str, lo: int, hi: int) -> list[dict]:
    """The row groups of a stored map that touch lo to hi - 1, read by whoever asks; the map is sorted, so statistics skip most of it."""
    import pyarrow.dataset as ds

    fs, inside = pafs.FileSystem.from_uri(table) if ":" in table.split("/", 1)[0] else (pafs.LocalFileSystem(), table)
    found = ds.dataset(inside, filesystem=fs, format="parquet").to_table(filter=(ds.field("start") < hi) & (ds.field("start") + ds.field("n") > lo))
    return found.to_pylist()


@dataclass
class LazyIndex:
    """An index that stays where it is: its files are neither sorted nor rewritten, only their row groups are mapped."""

    df: DataFrame
    groups: DataFrame
    n: int
    n_groups: int

    @classmethod
    def of(cls, df: DataFrame, max_size: int | None = None) -> LazyIndex:
        """Of a Parquet table; its order is that of the files' paths, then of rows. The map is kept in the shared folder."""
        groups = materialize(footers(offsets(file_counts(df))).orderBy("start"), "row_groups")
        told = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("groups")).first()
        return cls(df, groups, told.n if max_size is None else min(told.n, max_size), told.groups)

    def _schema(self, columns: Sequence[str] | None) -> T.StructType:
        return self.df.schema if columns is None else T.StructType([self.df.schema[c] for c in columns])

    def _width(self) -> int:
        return max(1, self.n // max(1, self.n_groups))

    def slice(self, start: int, end: int, step: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows at start, start + step, ... before end, with their position."""
        if step < 1 or start < 0:
            raise ValueError("step must be positive and start not negative")
        end = min(end, self.n)
        return read(slice_pieces(self.groups, start, end, step), self._schema(columns), max(1, -(-(end - start) // ROWS_PER_TASK))).drop(TAG)

    def rows(self, wanted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows at the positions in column `_pos`, each once, for any number of them."""
        asked = wanted.where((F.col(POS) >= 0) & (F.col(POS) < self.n)).select(F.col(POS).cast("long").alias("lo")).distinct()
        return read_blocks(blocks(self.groups, asked, self._width()), self._schema(columns), _tasks(wanted))

    def chunks(self, wanted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of chunks (lo, hi, tag) with the tag of their chunk. Chunks may overlap."""
        return read(piece_join(self.groups, wanted, self._width()), self._schema(columns), _tasks(wanted))

    def partition(self, rank: int, ranks: int, columns: Sequence[str] | None = None, **bounds) -> DataFrame:
        """One consumer's rows; `bounds` as for `position.rank_bounds`."""
        from ..operators.position import rank_bounds

        return self.slice(*rank_bounds(self.n, rank, ranks, **bounds), columns)
