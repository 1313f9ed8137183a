"""Reads by position open the row groups that they need, in any number of files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestream.operators import position
from lodestream.plans.index import StreamingSource
from lodestream.sources import rowgroups
from lodestream.sources.rowgroups import LazyIndex


def write(path, start, n, group):
    pq.write_table(pa.table({"id": range(start, start + n), "text": [f"row {i}" * 40 for i in range(start, start + n)]}), path, row_group_size=group, compression="none")


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    """One file of ten row groups of 100 rows, of which the sixth cannot be read."""
    path = tmp_path_factory.mktemp("broken") / "t.parquet"
    write(path, 0, 1000, 100)
    meta = pq.ParquetFile(path).metadata.row_group(5)
    start, size = meta.column(0).file_offset or meta.column(0).data_page_offset, sum(meta.column(c).total_compressed_size for c in range(2))
    first = min(meta.column(c).dictionary_page_offset or meta.column(c).data_page_offset for c in range(2))
    data = bytearray(path.read_bytes())
    data[first : first + size] = b"\xff" * size
    path.write_bytes(data)
    return str(path), start


def test_untouched_groups_are_not_read(spark, broken):
    table = spark.read.parquet(broken[0])
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(position.scan_slice(table, 250, 350)) == list(range(250, 350))
    assert ids(position.scan_slice(table, 600, 1000, 7)) == list(range(600, 1000, 7))
    assert ids(position.scan_rows(table, [3, 999, 3, 421])) == [3, 421, 999]
    lazy = LazyIndex.of(table)
    assert lazy.n == 1000 and lazy.n_groups == 10
    assert ids(lazy.slice(0, 500)) == list(range(500)) and ids(lazy.slice(995, 2000)) == list(range(995, 1000))
    assert ids(lazy.rows(spark.createDataFrame([(499,), (600,), (600,), (-1,), (1000,)], "_pos long"))) == [499, 600]
    with pytest.raises(Exception, match="(?s)."):
        lazy.slice(560, 561).collect()


def test_plan_has_neither_sort_nor_scan_of_the_table(spark, broken):
    """A slice of a lazy index filters the map of row groups; the filter on positions reaches its scan."""
    plan = LazyIndex.of(spark.read.parquet(broken[0])).slice(250, 350)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "t.parquet" not in plan and "LessThan(start,350)" in plan


def test_more_files_than_a_list_would_hold(spark, tmp_path):
    """5,000 files: a slice over most of them still opens each file once and scans no table."""
    n = 5000
    for i in range(n):
        pq.write_table(pa.table({"id": [2 * i, 2 * i + 1]}), tmp_path / f"{i:05d}.parquet", compression="none")
    table = spark.read.schema("id long").parquet(str(tmp_path))
    found = position.scan_slice(table, 11, 2 * n - 7, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = found.agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.sum(F.expr("id - _pos")).alias("d")).first()
    want = range(11, 2 * n - 7, 3)
    assert (got.n, got.s, got.d) == (len(want), sum(want), 0)
    lazy = LazyIndex.of(table)
    assert lazy.n == 2 * n and lazy.n_groups == n
    assert [r.id for r in lazy.rows(spark.createDataFrame([(9999,), (5000,)], "_pos long")).orderBy("id").collect()] == [5000, 9999]


def test_types_nulls_missing_and_partition_columns(spark, tmp_path):
    df = spark.sql("SELECT id, IF(id % 3 = 0, NULL, CAST(id AS DECIMAL(10, 2))) AS d, timestamp_seconds(id * 86400) AS t, date_add(DATE'2020-01-01', CAST(id AS INT)) AS day, array(struct(id AS a, 'x' AS b)) AS s, CAST(CAST(id AS STRING) AS BINARY) AS raw, id % 2 AS part FROM range(40)")
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    whole = {r._pos: r for r in position.with_position(table).collect()}
    got = LazyIndex.of(table).slice(0, 100).collect()
    assert len(got) == 40 and all(r == whole[r._pos] for r in got)
    wide = spark.read.schema("id long, more string").parquet(str(tmp_path / "t"))
    assert LazyIndex.of(wide).slice(0, 3).where("more is null").count() == 3


def test_filtered_tables_are_scanned_by_spark(spark, broken):
    table = spark.read.parquet(broken[0])
    assert rowgroups.readable(table) and rowgroups.readable(table.select("text"))
    assert not rowgroups.readable(table.where("id > 3")) and not rowgroups.readable(table.select((F.col("id") + 1).alias("id")))
    computed = spark.range(10).withColumn("x", F.col("id") * 2)
    assert not rowgroups.readable(computed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "t"))
    lazy = LazyIndex.of(spark.read.parquet(str(tmp_path / "t")))
    assert lazy.n == 0 and lazy.slice(0, 10).count() == 0 and lazy.rows(spark.createDataFrame([(0,)], "_pos long")).count() == 0


def test_lazy_dataset(spark, tmp_path):
    """Every consumer's epochs: the same rows in another order, resumed where they were left; max_size caps; unaligned consumers see all."""
    write(tmp_path / "t.parquet", 0, 1000, 90)
    make = lambda **more: StreamingSource(spark, str(tmp_path / "t.parquet"), key="id", shuffle_seed=3, lazy=True, chunk_size=130, **more)
    source = make()
    assert len(source) == 1000
    first = [r.id for r in source.plan(1, 3).orderBy("place").collect()]
    assert first != sorted(first) and set(first) <= set(range(333, 666)) and len(first) == 333
    chunks = {r.chunk_id: (r.lo, r.hi, r.tag) for r in source.chunks(1, 3).collect()}
    for lo, hi, tag in chunks.values():
        assert set(first[tag : tag + hi - lo]) == set(range(lo, hi))
    source.load_state_dict({"epoch": 0, "sample_in_epoch": 200})
    assert [r.id for r in source.plan(1, 3).orderBy("place").collect()] == first[200:]
    source.load_state_dict({"epoch": 1, "sample_in_epoch": 0})
    second = [r.id for r in source.plan(1, 3).orderBy("place").collect()]
    assert sorted(second) == sorted(first) and second != first
    assert len(make(max_size=70)) == 70
    alone = make(unaligned=True)
    orders = [[r.id for r in alone.plan(k, 2).orderBy("place").collect()] for k in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(1000 // 8 * 8)) and orders[0] != orders[1]
    assert [r.id for r in make().take([5, 999, 5])] == [5, 999, 5]
    with pytest.raises(ValueError, match="lazy"):
        make(sql="SELECT * FROM dataframe")


def test_requests_do_not_follow_the_size_of_a_group(spark, tmp_path):
    """Positions come in blocks of bounded size; a group is read over several blocks and decoded batches, an empty request gives nothing."""
    for i, n in enumerate((150_000, 20_000)):
        spark.range(i * 10**6, i * 10**6 + n).coalesce(1).write.mode("append").parquet(str(tmp_path / "t" / f"k={i}"))
    lazy = rowgroups.LazyIndex.of(spark.read.parquet(str(tmp_path / "t")))
    asked = spark.range(0, 180_000, 3).select(F.col("id").alias("lo"))
    sizes = [r.n for r in rowgroups.blocks(lazy.groups, asked, lazy._width()).select(F.size("at").alias("n")).collect()]
    assert max(sizes) <= rowgroups.BLOCK and sum(sizes) == -(-170_000 // 3)
    got = lazy.rows(asked.union(asked).select(F.col("lo").alias("_pos"))).collect()
    assert sorted((r._pos, r.id, r.k) for r in got) == [(p, p if p < 150_000 else 10**6 + p - 150_000, int(p >= 150_000)) for p in range(0, 170_000, 3)]
    assert lazy.rows(asked.where("lo < 0").select(F.col("lo").alias("_pos"))).count() == 0
