"""Chunks of a lazy index as a stream: Spark asks for the next ones when it has finished the last.

The source `lodestream_chunks` has offsets (epoch, chunk): how many chunks of an epoch have been
handed out, in the consumer's seeded order. A micro-batch admits at most `per_trigger` chunks, so
no more than that is pending, whatever the speed of what follows; the next are scheduled only after
the batch before has been planned. A task reads the row groups that its chunks touch: one chunk, or as
many small ones as have `ROWS_PER_TASK` rows together. A restarted query goes on from the offsets in
its checkpoint. One batch never spans two epochs.

A micro-batch costs Spark the same however few rows it has, so an epoch of many small ones lasts as
long as their number. Lanes share it: each is a query of its own, with its own checkpoint and limit,
over a run of the epoch's micro-batches. Together they hand out the same micro-batches as one query.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import mixed_seed
from ..sources.rowgroups import ROWS_PER_TASK, LazyIndex, groups_of, read_group

NAME = "lodestream_chunks"
#: What the stream adds to the index's columns: position, place of the chunk's first row in the epoch, epoch.
EXTRA = [T.StructField("_pos", T.LongType()), T.StructField("_tag", T.LongType()), T.StructField("_epoch", T.LongType())]


def chunk_order(pieces: int, seed: int | None, epoch: int, rank: int) -> list[int]:
    """A consumer's chunks in the order of an epoch: one number per chunk of one consumer. The order is that of `StreamingSource.chunks`."""
    if seed is None:
        return list(range(pieces))
    mixed = mixed_seed(seed, epoch, rank)
    return sorted(range(pieces), key=lambda i: (hashlib.md5(f"{mixed}-{i}".encode()).hexdigest(), i))


def lane_start(pieces: int, per_trigger: int, lane: int, lanes: int) -> int:
    """The first chunk of a lane in every epoch, at a border of micro-batches; that of lane `lanes` is the end of the epoch."""
    batches = -(-pieces // per_trigger)
    return min(pieces, batches * lane // lanes * per_trigger)


@dataclass
class Chunk(InputPartition):
    lo: int
    hi: int
    tag: int
    epoch: int

    @property
    def parts(self) -> list[Chunk]:
        return [self]


@dataclass
class Chunks(InputPartition):
    parts: list[Chunk]


class ChunkReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.table = schema, options["groups"]
        self.start, self.size, self.pieces = (int(options[k]) for k in ("start", "size", "pieces"))
        self.rank, self.epochs, self.per_trigger = int(options["rank"]), int(options["epochs"]), int(options["per_trigger"])
        self.per_task, lane, lanes = (int(options.get(k, v)) for k, v in (("per_task", 1), ("lane", 0), ("lanes", 1)))
        self.lo, self.hi = (lane_start(self.pieces, self.per_trigger, i, lanes) for i in (lane, lane + 1))
        self.seed = int(options["seed"]) if options.get("seed") else None
        self.first = {"epoch": int(options["epoch"]), "chunk": max(self.lo, int(options["chunk"]))}
        self.last_epoch = self.first["epoch"] + self.epochs
        self.at = _last_offset(options.get("checkpoint")) or self.first
        self.ordered: tuple[int, list[int]] | None = None  # the order of the epoch that is being planned

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        """As far as one micro-batch may go: on from the last planned one, to the lane's end in its epoch at most."""
        epoch, chunk = self.at["epoch"], self.at["chunk"]
        if chunk >= self.hi:
            epoch, chunk = epoch + 1, self.lo
        if self.epochs and epoch >= self.last_epoch or self.lo >= self.hi:
            return self.at
        return {"epoch": epoch, "chunk": min(self.hi, chunk + self.per_trigger)}

    def partitions(self, start: dict, end: dict) -> list[Chunk] | list[Chunks]:
        self.at = end
        if start == end:
            return []
        first = start["chunk"] if start["epoch"] == end["epoch"] else self.lo
        if self.ordered is None or self.ordered[0] != end["epoch"]:
            self.ordered = end["epoch"], chunk_order(self.pieces, self.seed, end["epoch"], self.rank)
        order = self.ordered[1]
        made = [Chunk(self.start + order[k] * self.size, self.start + (order[k] + 1) * self.size, k * self.size, end["epoch"]) for k in range(first, end["chunk"])]
        return made if self.per_task == 1 else [Chunks(made[i : i + self.per_task]) for i in range(0, len(made), self.per_task)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ordered": None}  # tasks need no order

    def read(self, task: Chunk | Chunks) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(T.StructType(self.schema.fields[: -len(EXTRA)]))
        for chunk in task.parts:
            for g in groups_of(self.table, chunk.lo, chunk.hi):
                piece = {"lo": max(chunk.lo, g["start"]), "hi": min(chunk.hi, g["start"] + g["n"]), "step": 1, "tag": chunk.tag}
                for b in read_group(arrow, g["file"], g["grp"], g["start"], [piece]):
                    yield b.append_column("_epoch", pa.array([chunk.epoch] * b.num_rows, pa.int64()))

    def commit(self, end: dict) -> None:
        pass


def _last_offset(checkpoint: str | None) -> dict | None:
    """The newest offset that Spark has logged for a query with this one source."""
    if not checkpoint:
        return None
    fs, inside = pafs.FileSystem.from_uri(checkpoint) if ":" in checkpoint.split("/", 1)[0] else (pafs.LocalFileSystem(), checkpoint)
    logged = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{inside}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not logged:
        return None
    with fs.open_input_stream(max(logged, key=lambda p: int(p.rsplit("/", 1)[1]))) as f:
        return json.loads(f.read().decode().strip().split("\n")[-1])


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["ddl"]

    def streamReader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(schema, dict(self.options))


@contextmanager
def plain_checkpoints(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside write offsets and commits through Hadoop's FileSystem, as Spark does where a scheme has no FileContext: a fifth of the time per micro-batch on local disks."""
    conf, name = spark.conf, "spark.sql.streaming.checkpointFileManagerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def chunk_stream(
    spark: SparkSession, lazy: LazyIndex, chunk: int, rank: int = 0, ranks: int = 1, seed: int | None = None, epoch: int = 0, epochs: int = 1, per_trigger: int = 4, sample_in_epoch: int = 0, checkpoint: str | None = None,
    columns: Sequence[str] | None = None, lane: int = 0, lanes: int = 1,
) -> DataFrame:
    """A consumer's rows of a lazy index, chunk by chunk, with `_pos`, `_tag` and `_epoch`; endless with epochs 0.

    It begins with the chunk that holds `sample_in_epoch`. `checkpoint` is the query's own
    checkpoint folder, so that a restarted query knows where it is. Of several lanes, this is one.
    """
    each = lazy.n // ranks
    pieces = -(-each // chunk)
    size = each // pieces if pieces else 0
    spark.dataSource.register(ChunkSource)
    path = lazy.groups.inputFiles()[0].rsplit("/", 1)[0] if lazy.n else ""
    told = {"groups": path, "start": rank * each, "size": size, "pieces": pieces, "rank": rank, "seed": "" if seed is None else seed, "epoch": epoch, "epochs": epochs, "chunk": sample_in_epoch // size if size else 0, "per_trigger": per_trigger}
    told |= {"per_task": max(1, ROWS_PER_TASK // size) if size else 1, "lane": lane, "lanes": lanes}
    ddl = T.StructType([*lazy._schema(columns).fields, *EXTRA]).toDDL()
    reader = spark.readStream.format(NAME).option("ddl", ddl)
    for k, v in {**told, **({"checkpoint": checkpoint} if checkpoint else {})}.items():
        reader = reader.option(k, str(v))
    return reader.load()
