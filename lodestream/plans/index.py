"""The index pipeline (resolve, shuffle, query, limit, prune) and the dataset built on it."""

from __future__ import annotations

import hashlib
import json
import secrets
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import path_key
from ..functions.scalars import mixed_seed, parse_bytes, worker_budget
from ..operators import fields, ordering, position
from ..operators.cache import eviction, fetch, fetch_plan
from ..operators.transforms import Transform, chain
from ..sources.resolver import data_type, resolve
from ..sources.rowgroups import TAG, LazyIndex
from ..sources.shared import materialize
from .dialect import to_spark

SAMPLE_KEY, DATA_TYPE, DISK_USAGE = "__sample_key__", "__data_type__", "__worker_disk_usage__"


def run_sql(df: DataFrame, sql: str) -> DataFrame:
    """A query over the table `dataframe`. It is bound to a view of its own, so queries do not see each other."""
    view = f"index_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(to_spark(sql, view))
    finally:
        df.sparkSession.catalog.dropTempView(view)


def run_sql_per_chunk(df: DataFrame, sql: str, chunk: int, schema: str, order: str = position.POS, n: int | None = None) -> DataFrame:
    """A query whose limits, orders and aggregates hold inside each chunk of `chunk` positions.

    The query becomes a lateral subquery of the chunks, which Spark turns into windows and groups
    partitioned by chunk. A limit without an order takes any rows of the chunk. The result is cast
    to the schema. Where the table has n rows with positions 0 to n - 1, the chunks follow from n
    and the rows are dealt by chunk; otherwise they are the distinct chunks of its rows.
    """
    if n is None:
        return sql_by(df.withColumn("_chunk", F.floor(F.col(order) / chunk)), sql, schema, df.columns).drop("_chunk")
    chunks = df.sparkSession.range(-(-n // chunk)).withColumnRenamed("id", "_chunk")
    return sql_by(position.by_chunk(df, chunk, n, order), sql, schema, df.columns, chunks).drop("_chunk")


def sql_by(df: DataFrame, sql: str, schema: str, columns: Sequence[str], chunks: DataFrame | None = None) -> DataFrame:
    """(_chunk and the schema's columns): a query run by itself over the rows of each `_chunk`, of which it sees the columns."""
    view, listed = f"index_{uuid.uuid4().hex}", f"chunks_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    (df.select("_chunk").distinct() if chunks is None else chunks).createOrReplaceTempView(listed)
    names = ", ".join(f"`{c}`" for c in columns)
    rows = f"(SELECT {names} FROM {view} WHERE _chunk = _chunks._chunk)"
    try:
        out = df.sparkSession.sql(f"SELECT _chunks._chunk AS _chunk, _rows.* FROM {listed} AS _chunks, LATERAL ({to_spark(sql, rows)}) AS _rows")
    finally:
        df.sparkSession.catalog.dropTempView(view)
        df.sparkSession.catalog.dropTempView(listed)
    return out.select("_chunk", *[F.col(f"`{f.name}`").cast(f.dataType) for f in T.StructType.fromDDL(schema)])


def process_index(df: DataFrame, sql: str | None = None, shuffle_seed: int | None = None, keys: Sequence[str] = (), max_size: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Shuffle, query, limit and prune, in that order; a query's own ORDER BY wins. Catalyst pushes the query's filters and the columns into the scan."""
    if columns is not None and not columns:
        raise ValueError("columns_to_keep must not be empty")
    if sql:
        df = run_sql(df, sql)
    if max_size is not None and keys and not _ordered(sql):
        df = ordering.first_rows(df, max_size, shuffle_seed, *keys)
    else:
        if shuffle_seed is not None and not _ordered(sql):
            df = ordering.shuffled(df, shuffle_seed, *keys)
        df = df if max_size is None else df.limit(max_size)
    return df if columns is None else df.select(*columns)


def _ordered(sql: str | None) -> bool:
    return bool(sql) and "order by" in " ".join(sql.lower().split())


@dataclass
class StreamingSource:
    """A dataset over an index source: ordered by seed and epoch, sliced for consumers, fetched, transformed, resumable.

    With `lazy`, a Parquet index is used where it is: no sort, no rewrite, only a map of its row
    groups. Consumers then read their share in chunks of `chunk_size`, chunks and the rows of each
    in seeded order, and a query holds per chunk.
    """

    spark: SparkSession
    src: str
    data_type: str | None = None
    name: str | None = None
    key: str = "index"
    shuffle_seed: int | None = None
    sql: str | None = None
    sql_scope: str = "global"
    sql_schema: str | None = None
    chunk_size: int = 30_000
    max_size: int | None = None
    columns_to_keep: Sequence[str] | None = None
    max_files: int | None = None
    lazy: bool = False
    fetch_columns: Sequence[str] = ()
    dst: str | None = None
    allow_missing_columns: bool = False
    before_fetch: Sequence[Transform] = ()
    transforms: Sequence[Transform] = ()
    cache_limit: int | str | None = None
    retries: int = 3
    on_error: str = "fail"
    unaligned: bool = False
    epoch: int = 0
    sample_in_epoch: int = 0
    _index: DataFrame | None = field(default=None, repr=False)
    _stored: DataFrame | None = field(default=None, repr=False)
    _lazy: LazyIndex | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.data_type is not None:
            self.data_type = data_type(self.data_type)
        if self.key in self.fetch_columns:
            raise ValueError("the key column cannot be fetched")
        if self.sql_scope not in ("global", "chunk"):
            raise ValueError("sql_scope must be global or chunk")
        if self.sql_scope == "chunk" and (self.chunk_size < 100 or not self.sql_schema):
            raise ValueError("a query per chunk needs a schema and chunks of 100 rows or more")
        if self.lazy and (self.columns_to_keep is not None or self.sql and self.sql_scope != "chunk"):
            raise ValueError("a lazy index takes queries per chunk only, and no columns_to_keep")
        if self.shuffle_seed is not None and self.shuffle_seed < -1:
            raise ValueError("shuffle_seed must be -1 (random) or more")
        if self.shuffle_seed == -1:
            self.shuffle_seed = secrets.randbits(31)
        self.cache_limit = parse_bytes(self.cache_limit)
        if self.name is None:
            self.name = self.spark.range(1).select(path_key(F.lit(self.src), 3, True).alias("k")).first().k

    @property
    def index(self) -> DataFrame:
        """The index with a position, after query, limit and pruning."""
        if self.lazy:
            return self.lazy_index.slice(0, self.lazy_index.n)
        if self._index is None:
            df = resolve(self.spark, self.src, self.data_type, self.max_files)
            if self.sql and self.sql_scope == "chunk":
                df = run_sql_per_chunk(position.with_position(df), self.sql, self.chunk_size, self.sql_schema, n=df.count())
                df = process_index(df, None, None, [self.key], self.max_size, self.columns_to_keep)
            else:
                df = process_index(df, self.sql, None, [self.key], self.max_size, self.columns_to_keep)
            # written in key order: positions follow the key and stay as they are for every later job
            self._stored = materialize(df.orderBy(F.col(f"`{self.key}`")), "index")
            self._index = position.with_position(self._stored)
        return self._index

    @property
    def stored(self) -> DataFrame:
        """The index as it was written, for scans of a part of it."""
        _ = self.index
        return self._stored

    @property
    def lazy_index(self) -> LazyIndex:
        if self._lazy is None:
            self._lazy = LazyIndex.of(resolve(self.spark, self.src, self.data_type, self.max_files), self.max_size)
        return self._lazy

    def __len__(self) -> int:
        return self.lazy_index.n if self.lazy else self.index.count()

    def chunks(self, rank: int = 0, ranks: int = 1, epoch: int | None = None) -> DataFrame:
        """(chunk_id, lo, hi, tag) of a consumer's chunks of a lazy index; tag is the place of a chunk's first row in the epoch. Unaligned consumers share all chunks, each in an order of its own."""
        part, parts = (0, 1) if self.unaligned else (rank, ranks)
        each = self.lazy_index.n // parts
        pieces = -(-each // self.chunk_size)
        size = each // pieces if pieces else 0
        df = self.spark.range(pieces).withColumnRenamed("id", "chunk_id")
        order = [F.col("chunk_id")] if self.shuffle_seed is None else ordering.hash_order(mixed_seed(self.shuffle_seed, self.epoch if epoch is None else epoch, rank), F.col("chunk_id"))
        df = df.withColumn("tag", (F.row_number().over(Window.orderBy(*order)) - 1) * F.lit(size).cast("long"))  # one row per chunk
        lo = F.lit(part * each) + F.col("chunk_id") * size
        return df.select("chunk_id", lo.alias("lo"), (lo + size).alias("hi"), "tag")

    def _lazy_order(self, rank: int, ranks: int, epoch: int, after: int) -> DataFrame:
        """Rows with their place. Chunks that end before `after` are not read."""
        lazy, seed = self.lazy_index, self.shuffle_seed
        chunks = self.chunks(rank, ranks, epoch)
        rows = lazy.chunks(chunks.where(F.col("tag") + F.col("hi") - F.col("lo") > after)).withColumnRenamed(TAG, "_chunk")
        by = position.POS
        if self.sql:
            rows, by = sql_by(rows, self.sql, self.sql_schema, lazy.df.columns), self.key
        order = [F.col(f"`{by}`")] if seed is None else ordering.hash_order(mixed_seed(seed, epoch, rank), F.col(f"`{by}`"))
        inside = Window.partitionBy("_chunk").orderBy(*order)  # at most chunk_size rows
        return rows.withColumn("place", F.col("_chunk") + F.row_number().over(inside) - 1).drop("_chunk")

    def order(self, rank: int = 0, ranks: int = 1, epoch: int | None = None, tail: str = "drop") -> DataFrame:
        """This consumer's rows with their `place` in the epoch. Unaligned consumers each see everything in an order of their own."""
        epoch = self.epoch if epoch is None else epoch
        if self.lazy:
            return self._lazy_order(rank, ranks, epoch, 0)
        if not self.unaligned:
            start, end, step = position.rank_bounds(len(self), rank, ranks, tail=tail)
            mine = position.scan_slice(self.stored, start, end, step).withColumn("_local", F.col(position.POS) - start)
        else:
            mine = self.index.withColumn("_local", F.col(position.POS))
        return ordering.epoch_order(mine, self.shuffle_seed, epoch, rank, "_local").drop("_local")

    def repeated(self, epochs: int, rank: int = 0, ranks: int = 1) -> DataFrame:
        """This consumer's rows of several epochs from the present one on, each in its own order, with `epoch` and `place`."""
        parts = [self.order(rank, ranks, e).withColumn("epoch", F.lit(e).cast("long")) for e in range(self.epoch, self.epoch + epochs)]
        return reduce(DataFrame.unionByName, parts)

    def plan(self, rank: int = 0, ranks: int = 1) -> DataFrame:
        """What is left of the epoch after the saved progress, before fetching."""
        order = self._lazy_order(rank, ranks, self.epoch, self.sample_in_epoch) if self.lazy else self.order(rank, ranks)
        return chain(order.where(F.col("place") >= self.sample_in_epoch), self.before_fetch)

    def samples(self, rank: int = 0, ranks: int = 1) -> DataFrame:
        """Samples with their key and type columns, fetched and transformed."""
        df = self.plan(rank, ranks)
        df = df.withColumn(SAMPLE_KEY, F.col(f"`{self.key}`"))
        if self.data_type:
            df = df.withColumn(DATA_TYPE, F.lit(self.data_type))
        if self.fetch_columns:
            df = self._fetched(df)
        return chain(df, self.transforms)

    def _fetched(self, df: DataFrame) -> DataFrame:
        if self.dst is None:
            raise ValueError("fetching needs dst")
        df = fields.required_columns(df, self.fetch_columns, self.allow_missing_columns)
        done = fetch(fetch_plan(df, self.key, self.fetch_columns, self.dst, self.name), self.retries, self.on_error)
        wide = done.where("ok").groupBy("key").pivot("field", list(self.fetch_columns)).agg(F.first("destination"))
        usage = done.where("ok").groupBy("key").agg(F.sum("bytes").alias(DISK_USAGE))
        wide = wide.withColumnsRenamed({c: f"_at_{c}" for c in self.fetch_columns})
        df = df.join(wide.join(usage, "key").withColumnRenamed("key", "_k"), F.col(f"`{self.key}`") == F.col("_k")).drop("_k")
        for c in self.fetch_columns:
            df = df.withColumn(c, F.col(f"_at_{c}")).drop(f"_at_{c}")
        return df

    def resident(self, rank: int = 0, ranks: int = 1, nodes: int | None = None) -> DataFrame:
        """Which samples a cache of the limit's size holds, sample by sample. With `nodes`, the limit is a node's and each of its consumers has an equal share."""
        limit = self.cache_limit if nodes is None else worker_budget(self.cache_limit, ranks, nodes)
        return eviction(self.samples(rank, ranks), "place", DISK_USAGE, limit)

    def iterate(self, rank: int = 0, ranks: int = 1, epochs: int | None = 1) -> Iterator[Row]:
        """Rows in order, one partition at a time on the driver, advancing the progress; endless with epochs None."""
        done = 0
        while epochs is None or done < epochs:
            for row in self.samples(rank, ranks).orderBy("place").toLocalIterator(prefetchPartitions=True):
                self.sample_in_epoch = row["place"] + 1
                yield row
            self.epoch, self.sample_in_epoch, done = self.epoch + 1, 0, done + 1

    def take(self, positions: Sequence[int], attempts: int = 1, seed: int = 0) -> list[Row]:
        """Rows at positions. A row that cannot be fetched is replaced by another position, drawn by seed, in up to `attempts` attempts."""
        n, wanted, out = len(self), list(positions), {}
        for attempt in range(attempts):
            left = [i for i in range(len(wanted)) if i not in out]
            if not left:
                break
            asked = {i: wanted[i] if attempt == 0 else int(hashlib.md5(f"{seed}-{attempt}-{wanted[i]}".encode()).hexdigest()[:8], 16) % n for i in left}
            df = self.lazy_index.rows(self.spark.createDataFrame([(p,) for p in set(asked.values())], f"{position.POS} long")) if self.lazy else position.scan_rows(self.stored, list(asked.values()))
            df = chain(df, self.before_fetch).withColumn(SAMPLE_KEY, F.col(f"`{self.key}`"))
            if self.fetch_columns:
                df = self._fetched(df)
            got = {r[position.POS]: r for r in chain(df, self.transforms).collect()}
            out |= {i: got[p] for i, p in asked.items() if p in got}
        if len(out) < len(wanted):
            raise LookupError(f"no sample for positions {[wanted[i] for i in range(len(wanted)) if i not in out]}")
        return [out[i] for i in range(len(wanted))]

    def state_dict(self) -> dict[str, int]:
        return {"epoch": self.epoch, "sample_in_epoch": self.sample_in_epoch}

    def load_state_dict(self, state: dict[str, int]) -> None:
        self.epoch, self.sample_in_epoch = state["epoch"], state["sample_in_epoch"]

    def describe(self) -> str:
        """A hash of what determines the samples."""
        parts = {k: str(getattr(self, k)) for k in ("src", "data_type", "key", "shuffle_seed", "sql", "sql_scope", "max_size", "columns_to_keep", "fetch_columns", "allow_missing_columns")}
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def mixed_state(sources: dict[str, StreamingSource], step: int) -> dict[str, Any]:
    """State of several sources and of the schedule that mixes them."""
    return {"step": step, "streams": {k: s.state_dict() for k, s in sources.items()}}


def load_mixed_state(sources: dict[str, StreamingSource], state: dict[str, Any]) -> int:
    if set(state["streams"]) != set(sources):
        raise ValueError(f"the state has streams {sorted(state['streams'])}")
    for k, s in sources.items():
        s.load_state_dict(state["streams"][k])
    return state["step"]
