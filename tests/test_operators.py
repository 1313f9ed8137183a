import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import media, paths
from lodestream.operators import cache, fields, mixing, ordering, position, splits, transforms
from lodestream.plans.dialect import to_spark
from lodestream.plans.export import ExportConfig, export
from lodestream.plans.index import StreamingSource, process_index, run_sql
from lodestream.plans.mixed import MixedLoader
from lodestream.sources import connectors, resolver, sinks
from lodestream.streaming import state

PATH_KEYS = [
    ("s3://bucket/folder/file.txt", 2, False, "s3-folder-file.txt"), ("s3://bucket/folder/", 2, False, "s3-bucket-folder"), ("gs://my-bucket/data/2023/part-1.parquet", 3, False, "gs-data-2023-part-1.parquet"), ("file:///home/user/data.csv", 1, False, "file-data.csv"),
    ("https://example.com/resources/image.png", -1, False, "https-example.com-resources-image.png"), ("/var/log/syslog", 2, False, "log-syslog"), ("s3://bucket/onlyfile", 2, False, "s3-bucket-onlyfile"), ("s3://bucket////weird///slashes///x.txt", 2, False, "s3-slashes-x.txt"),
    ("gs://my-bucket/data/2023/part-1.parquet", 2, True, "gs-2023-part-1"), ("https://example.com/resources/image.png", -1, True, "https-example.com-resources-image"), ("relative/path/to/thing", 2, True, "to-thing"), ("single", 1, False, "single"),
]


@pytest.mark.parametrize(("path", "parts", "drop", "key"), PATH_KEYS)
def test_path_key(spark, path, parts, drop, key):
    assert spark.range(1).select(paths.path_key(F.lit(path), parts, drop)).first()[0] == key


def test_extensions(spark):
    df = spark.createDataFrame([("/a/b.c/x.tar.GZ",), ("noext",), ("/a/.hidden",), ("d/y.",)], "p string")
    rows = df.select(paths.extension(F.col("p")), paths.full_extension(F.col("p")), paths.file_key(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(".GZ", ".tar.GZ", "x"), ("", "", "noext"), ("", ".hidden", ""), (".", ".", "y")]


@pytest.mark.parametrize(
    ("counts", "nodes", "want"),
    [
        ({"index1": 10, "index2": 10, "index3": 4}, 2, [[(0, 10), (0, 2), (0, 0)], [(0, 0), (2, 10), (0, 4)]]),
        ({"a": 5, "b": 6, "c": 7}, 4, [[(0, 5), (0, 0), (0, 0)], [(0, 0), (0, 5), (0, 0)], [(0, 0), (5, 6), (0, 3)], [(0, 0), (0, 0), (3, 7)]]),
        ({"a": 2, "b": 1}, 5, [[(0, 1), (0, 0)], [(1, 2), (0, 0)], [(0, 0), (0, 1)], [(0, 0), (0, 0)], [(0, 0), (0, 0)]]),
        ({"a": 0, "b": 0}, 4, [[(0, 0), (0, 0)]] * 4),
    ],
)
def test_balanced_bounds(spark, counts, nodes, want):
    df = position.balanced_bounds(spark.createDataFrame(list(counts.items()), "key string, n long"), nodes)
    got = {(r.node, r.key): (r.start, r.end) for r in df.collect()}
    assert [[got[i, k] for k in sorted(counts)] for i in range(nodes)] == want


def test_skewed_bounds(spark):
    counts = {"ds1": 17, "ds2": 3, "ds3": 91, "ds4": 6, "ds5": 1}
    got = {(r.node, r.key): (r.start, r.end) for r in position.balanced_bounds(spark.createDataFrame(list(counts.items()), "key string, n long"), 2).collect()}
    assert got[0, "ds3"] == (0, 39) and got[1, "ds3"] == (39, 91)


def test_positions_over_many_files(spark, tmp_path):
    for i, n in enumerate((30, 0, 50, 20)):
        spark.range(i * 100, i * 100 + n).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    df = position.with_position(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    rows = [tuple(r) for r in df.orderBy("_pos").select("id", "_pos").collect()]
    assert [p for _, p in rows] == list(range(100))
    assert [i for i, _ in rows] == [*range(30), *range(200, 250), *range(300, 320)]
    saved = sinks.save_index(df, str(tmp_path / "saved"), position="_pos")
    assert [r.id for r in position.slice_scan(saved, 25, 35, 5).orderBy("_pos").collect()] == [25, 200]


def test_positions_are_not_shuffled_by_file(spark, tmp_path):
    """Else all rows of one large file meet in one task, whatever the planner thinks of the offsets' size."""
    spark.range(0, 900, 1, 3).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = position.with_position(spark.read.parquet(str(tmp_path / "t")))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r._pos for r in df.orderBy("_pos").collect()] == list(range(900))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_schedules(spark):
    counts = {0: 2, 1: 3, 2: 4}
    run = lambda kind, n=18, **o: [r.group for r in mixing.schedule(spark, n, kind, counts, {0: 0.2, 1: 0.3, 2: 0.5}, **o).orderBy("step").collect()]
    assert run("consecutive") == [0, 0, 1, 1, 1, 2, 2, 2, 2] * 2
    assert run("consecutive_interleaved") == [0, 1, 2, 0, 1, 2, 1, 2, 2] * 2
    fixed, free = run("fixed_random_order", 36), run("random_order", 36)
    assert fixed[:9] == fixed[9:18] == fixed[27:] and len({tuple(free[i : i + 9]) for i in range(0, 36, 9)}) > 1
    assert all(Counter(free[i : i + 9]) == Counter({0: 2, 1: 3, 2: 4}) for i in range(0, 36, 9))
    assert run("random_order", 10, start=5) == run("random_order", 15)[5:]
    share = Counter(run("random", 4000))
    assert abs(share[2] / 4000 - 0.5) < 0.03
    with pytest.raises(ValueError):
        mixing.schedule(spark, 3, "other", counts)


def test_epoch_order_entropy(spark):
    """Every position is reached by a row about equally often over many seeds."""
    df = spark.range(64)
    places = np.zeros((64, 64))
    for seed in range(40):
        for r in ordering.epoch_order(df, seed, 0, 0, "id", chunk=10).collect():
            places[r.id, r.place] += 1
    assert (places.sum(0) == 40).all() and (places.sum(1) == 40).all()
    p = places.sum(1, keepdims=True)
    assert (-(places / p) * np.log2(np.where(places > 0, places / p, 1))).sum(1).mean() > 0.95 * np.log2(40) * 0.9


def test_eviction_example_and_brute_force(spark):
    def run(sizes, limit):
        rows = cache.eviction(spark.createDataFrame(list(enumerate(sizes)), "i long, size long"), "i", "size", limit, chunk=7).orderBy("i").collect()
        return [r.evicted_at for r in rows]

    assert run([600, 600, 300], 1024) == [1, None, None]
    assert run([5, 5], None) == [None, None]
    r = random.Random(1)
    for _ in range(6):
        sizes, limit = [r.choice([0, 1, 5, 50, 300]) for _ in range(60)], r.choice([0, 10, 200])
        held, usage, want = [], 0, [None] * len(sizes)
        for i, s in enumerate(sizes):
            held.append(i)
            usage += s
            while held and usage > limit:
                j = held.pop(0)
                usage -= sizes[j]
                want[j] = i
        assert run(sizes, limit) == want


def test_fetch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for i in range(3):
        (tmp_path / "src" / f"{i}.JPG").write_bytes(b"x" * (i + 1))
    rows = [(i, str(tmp_path / "src" / f"{i}.JPG")) for i in range(4)] + [(9, "")]
    df = spark.createDataFrame(rows, "index long, url string")
    plan = cache.fetch_plan(df, "index", ["url"], str(tmp_path / "out"), "set")
    done = {r.key: r for r in cache.fetch(plan, retries=1, on_error="quarantine").collect()}
    assert [done[i].bytes for i in range(3)] == [1, 2, 3] and not done[3].ok and done[3].error and 9 not in done
    assert (tmp_path / "out" / "set" / "2-url.jpg").read_bytes() == b"xxx"
    assert {r.key for r in cache.fetch(plan, 0, "skip").collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="No such file"):
        cache.fetch(plan, 0).collect()
    loaded = fields.load_files(df.where("index < 3"), "url", "content").orderBy("index").collect()
    assert [bytes(r.content) for r in loaded] == [b"x", b"xx", b"xxx"]


def test_sources(spark, tmp_path):
    df = spark.range(10).withColumn("name", F.concat(F.lit("n"), "id"))
    df.coalesce(1).write.parquet(str(tmp_path / "p" / "a.parquet"))
    (tmp_path / "x.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "y.json").write_text('[{"id": 1, "name": "a"}, {"id": 2}]')
    assert resolver.resolve(spark, str(tmp_path / "x.csv")).count() == 2
    assert resolver.resolve(spark, str(tmp_path / "y.json")).count() == 2
    assert resolver.resolve(spark, str(tmp_path / "p" / "a.parquet")).count() == 10
    (tmp_path / "many" / "deep").mkdir(parents=True)
    for i, n in enumerate(("b.csv", "a.csv", "deep/c.csv")):
        (tmp_path / "many" / n).write_text(f"id,name\n{i},x\n")
    assert resolver.resolve(spark, f"{tmp_path}/many/*.csv").count() == 3
    assert resolver.resolve(spark, f"{tmp_path}/many/*.csv", max_files=1).first().id == 1
    (tmp_path / "split_file_paths.txt").write_text(f"{tmp_path}/many/b.csv\n\n{tmp_path}/many/a.csv\n")
    assert resolver.resolve(spark, f"{tmp_path}/split_file_paths.txt").count() == 2
    for bad in (f"{tmp_path}/*/x.csv", f"{tmp_path}/*.xml"):
        with pytest.raises(ValueError):
            resolver.resolve(spark, bad)
    with pytest.raises(ValueError):
        resolver.resolve(spark, str(tmp_path))
    folder = tmp_path / "folder"
    folder.mkdir()
    for n in ("img1.jpg", "img1.txt", "img2.png", "img2.txt", "img2.meta.json", "other.txt"):
        (folder / n).write_text("x")
    out = resolver.resolve(spark, str(folder), "image").collect()
    assert [r["index"] for r in out] == ["img1", "img2"] and {"jpg", "png", "txt", "meta.json"} <= set(out[0].asDict())
    (folder / "more").mkdir()
    (folder / "more" / "img1.jpg").write_text("y")
    with pytest.raises(Exception, match="several files"):
        resolver.resolve(spark, str(folder), "image").collect()
    assert resolver.resolve(spark, str(folder), "image", strict=False).count() == 2
    assert resolver.listing(spark, str(folder), [".TXT"], ignore="img1.*").count() == 2
    assert resolver.type_of_extension("JPG") == "IMAGE" and resolver.data_type("image_latent") == "IMAGE_LATENT"
    assert resolver.count_rows(spark, str(tmp_path / "p")) == 10
    connectors.register(spark)
    got = spark.read.format("lodestream_files").option("urls", f"{folder}/img1.txt,{folder}/img2.txt").load()
    assert sorted(bytes(r.content) for r in got.collect()) == [b"x", b"x"]
    assert connectors.to_hadoop("s3://b/k") == "s3a://b/k" and connectors.to_hadoop("/x") == "/x"
    for bad in ("alipan://x", "sftp://h/x"):
        with pytest.raises(ValueError):
            connectors.to_hadoop(bad)


@pytest.mark.parametrize(
    ("sql", "spark_sql"),
    [
        ("SELECT 'dataframe' FROM dataframe", "SELECT 'dataframe' FROM v"),
        ('SELECT "a b" FROM "dataframe" d -- dataframe', "SELECT `a b` FROM v d "),
        ("SELECT a // 2, regexp_matches(b, 'x') FROM dataframe", "SELECT a  div  2, regexp_like(b, 'x') FROM v"),
        ("SELECT * EXCLUDE (a) FROM dataframe EXCEPT SELECT 1", "SELECT * EXCEPT (a) FROM v EXCEPT SELECT 1"),
        ("SELECT t.dataframe FROM dataframe t USING SAMPLE 5;", "SELECT t.dataframe FROM v t TABLESAMPLE (5 ROWS)"),
        ("SELECT a FROM t USING SAMPLE 10%", "SELECT a FROM t TABLESAMPLE (10 PERCENT)"),
    ],
)
def test_dialect(sql, spark_sql):
    assert to_spark(sql, "v").strip() == spark_sql.strip()


def test_dialect_runs(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (2, "c", 1)], "k int, n string, v int")
    sql = "WITH x AS (SELECT k, n FROM dataframe QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) SELECT n FROM x UNION ALL SELECT DISTINCT ON (k) n FROM dataframe ORDER BY k, v LIMIT 9"
    assert sorted(r.n for r in run_sql(df, sql.replace("DISTINCT ON (k) n FROM dataframe ORDER BY k, v LIMIT 9", "n FROM dataframe WHERE v = 3")).collect()) == ["a", "b", "c"]
    assert run_sql(df, "SELECT DISTINCT ON (k) k, n, v FROM dataframe ORDER BY k, v").count() == 2
    assert process_index(df, "SELECT n FROM dataframe ORDER BY v", 5, ["n"], 2).collect()[0].n == "c"
    assert process_index(df, max_size=1, columns=["k"]).columns == ["k"]
    with pytest.raises(ValueError):
        process_index(df, columns=[])


def test_streaming_source(spark, tmp_path):
    spark.createDataFrame([(f"k{i:03d}", i) for i in range(107)], "index string, v long").repartition(3).write.parquet(str(tmp_path / "i.parquet"))
    make = lambda **o: StreamingSource(spark, str(tmp_path / "i.parquet"), **o)
    plain = make()
    assert len(plain) == 107 and [r.v for r in plain.iterate()] == list(range(107)) and plain.epoch == 1
    seen = [r.v for rank in range(4) for r in make(shuffle_seed=3).samples(rank, 4).orderBy("place").collect()]
    assert len(seen) == 104 and sorted(seen) == list(range(104)) and seen != sorted(seen)
    one, again = make(shuffle_seed=3), make(shuffle_seed=3)
    first = [next(it).v for it in [one.iterate()] for _ in range(10)]
    again.load_state_dict(one.state_dict())
    rest = [r.v for r in again.samples().orderBy("place").collect()]
    assert one.state_dict() == {"epoch": 0, "sample_in_epoch": 10}
    assert first + rest == [r.v for r in make(shuffle_seed=3).samples().orderBy("place").collect()]
    assert [r.v for r in make(shuffle_seed=3, epoch=1).samples().orderBy("place").collect()] != first + rest
    filtered = make(sql="SELECT * FROM dataframe WHERE v % 2 = 0", max_size=20, columns_to_keep=["index", "v"])
    assert len(filtered) == 20
    chunked = make(sql="SELECT \"index\", v FROM dataframe ORDER BY v DESC LIMIT 2", sql_scope="chunk", chunk_size=100, sql_schema="index string, v long")
    assert len(chunked) == 4
    assert [r.v for r in plain.take([5, 3])] == [5, 3]
    with pytest.raises(LookupError):
        plain.take([1000], attempts=1)
    assert plain.take([1000], attempts=3)[0].v in range(107)
    assert make(shuffle_seed=-1).shuffle_seed >= 0 and make().describe() == make().describe() != make(shuffle_seed=1).describe()
    for bad in ({"shuffle_seed": -2}, {"fetch_columns": ["index"]}, {"sql_scope": "x"}, {"sql_scope": "chunk", "chunk_size": 5}, {"data_type": "smell"}):
        with pytest.raises(ValueError):
            make(**bad)


def test_source_fetches_and_evicts(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jpg").write_bytes(b"x" * (600, 600, 300)[i])
    spark.createDataFrame([(f"s{i}", str(tmp_path / f"{i}.jpg")) for i in range(3)], "index string, image string").write.parquet(str(tmp_path / "i.parquet"))
    source = StreamingSource(spark, str(tmp_path / "i.parquet"), "image", fetch_columns=["image"], dst=str(tmp_path / "out"), cache_limit="1kb", name="n")
    rows = source.resident().orderBy("place").collect()
    assert [r["__worker_disk_usage__"] for r in rows] == [600, 600, 300] and [r.resident for r in rows] == [False, True, True]
    assert rows[0].image.endswith("/n/s0-image.jpg") and rows[0]["__sample_key__"] == "s0" and rows[0]["__data_type__"] == "IMAGE"


def test_mixed_loader(spark, tmp_path):
    for name, n in (("a", 40), ("b", 10)):
        spark.createDataFrame([(f"{i:02d}", f"{name}{i}") for i in range(n)], "index string, v string").write.parquet(str(tmp_path / f"{name}.parquet"))
    streams = mixing.stream_group([{"name": "a", "ratio": 2, "batch_size": 4}, {"name": "b", "ratio": 1, "batch_size": 8, "batch_gpu": 4}])
    make = lambda: MixedLoader({n: StreamingSource(spark, str(tmp_path / f"{n}.parquet")) for n in "ab"}, streams, "consecutive")
    loader = make()
    heads = list(loader.iterate(6))
    assert [h["stream"] for h, _ in heads] == ["a", "a", "b", "b", "a", "a", "b", "b"] and [h["rounds_left"] for h, _ in heads] == [0, 0, 1, 0, 0, 0, 1, 0]
    assert [r.v for r in heads[0][1]] == ["a0", "a1", "a2", "a3"] and [r.v for r in heads[7][1]] == ["b4", "b5", "b6", "b7"]
    other = make()
    other.load_state_dict(loader.state_dict())
    assert next(other.iterate(1))[1][0].v == "a16"


def test_splits_and_export(spark, tmp_path):
    df = spark.range(1000)
    train, val = splits.split_validation(df, ["id"], 77)
    assert val.count() == 77 and train.count() == 923 and not train.join(val, "id").count()
    rest, tail = splits.split_tail(df, ["id"], 30)
    assert tail.count() == 30 and rest.count() == 970
    df.createOrReplaceTempView("numbers")
    raw = {"sql_query": "SELECT id FROM numbers QUALIFY row_number() OVER (PARTITION BY id % 500 ORDER BY id) = 1", "destination": str(tmp_path / "x.parquet"), "keys": ["id"], "val_ratio": 0.1, "max_num_val_rows": 20}
    assert export(spark, ExportConfig.parse(raw)) == (480, 20)
    assert spark.read.parquet(str(tmp_path / "x.parquet-val")).count() == 20
    with pytest.raises(ValueError):
        ExportConfig.parse(raw | {"local_tmp_path": 1})
    sinks.save_csv(df, str(tmp_path / "c"), single=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1000


def test_fields(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1.0}, [1.0, float("nan")]), (2, "", {}, [1.0])], "id int, s string, m map<string,double>, v array<double>")
    assert [tuple(r) for r in df.select(*[fields.values.is_dummy(df, c).alias(c) for c in ("id", "s", "m", "v", "none")]).collect()] == [(False, False, False, True, True), (False, True, True, False, True)]
    for bad in (lambda: fields.check_fields(df, ["q"]), lambda: fields.check_fields(df, {"id": "string"}), lambda: fields.add_constants(df, id=1), lambda: fields.rename_fields(df, {"q": "r"}), lambda: fields.required_columns(df, [])):
        with pytest.raises(fields.FieldError):
            bad()
    assert fields.rename_fields(df, {"id": "s"}).columns == ["s", "m", "v"]
    with pytest.raises(Exception, match="unknown class"):
        fields.encode_classes(df, "s", "c", ["a"]).collect()
    with pytest.raises(Exception, match="no value"):
        fields.first_real_field(df, ["s"], "o").collect()
    nested = df.select("id", F.struct(F.lit(9).alias("id"), F.lit(8).alias("z")).alias("t"))
    assert fields.merge_struct(nested, "t", "skip").first().asDict() == {"id": 1, "z": 8}
    assert fields.merge_struct(nested, "t", "overwrite").first().asDict() == {"id": 9, "z": 8}
    with pytest.raises(fields.FieldError):
        fields.merge_struct(nested, "t")
    assert fields.none_to_empty(spark.createDataFrame([(None,)], "s string")).first().s == ""


def test_transforms(spark):
    df = spark.range(4)

    def bad(row):
        if row["id"] == 2:
            raise ValueError("no")
        return [{"id": row["id"], "k": k} for k in "ab"]

    assert transforms.per_row(bad, "id long, k string", "skip")(df).count() == 6
    rows = transforms.per_row(bad, "id long, k string", "quarantine")(df).collect()
    assert len(rows) == 7 and sum("no" in (r._error or "") for r in rows) == 1
    assert transforms.per_row(bad, "id long, k string", "skip", first_only=True)(df).count() == 3
    with pytest.raises(Exception, match="no"):
        transforms.per_row(bad, "id long, k string")(df).collect()
    registry = transforms.Registry()
    registry.register("limit", lambda n: lambda d: d.limit(n))
    assert transforms.chain(df, registry.build([{"name": "limit", "n": 2}])).count() == 2 and "limit" in registry


def test_media(spark):
    row = spark.range(1)
    get = lambda c: row.select(c).first()[0]
    assert tuple(get(media.center_crop(F.lit(100), F.lit(50), 1.0))) == (25, 0, 75, 50)
    assert tuple(get(media.center_crop(F.lit(50), F.lit(100), 1.0))) == (0, 25, 50, 75)
    assert get(media.frame_times(F.lit(1.0), F.lit(2.0), F.lit(4), F.lit(2.2))) == [1.0, 1.5, 2.0, 2.2]
    assert get(media.frame_times(F.lit(1.0), F.lit(2.0), F.lit(1), F.lit(9.0))) == [1.0]
    assert tuple(get(media.soft_crop(F.lit(9.0), F.lit(9.5), F.lit(2.0), F.lit(10.0)))) == (8.0, 10.0)
    assert tuple(get(media.soft_crop(F.lit(0.2), F.lit(0.4), F.lit(2.0), F.lit(10.0)))) == (0.0, 2.0)
    assert get(media.hard_crop_ok(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(9.0))) is False
    assert get(media.pad_or_trim(F.array(*[F.lit(x).cast("float") for x in (1, 2, 3)]), 2)) == [1.0, 2.0]
    assert get(media.loudest_window(F.array(*[F.lit(x) for x in (9.0, -9.0, 0.0, 1.0)]), 2)) == 0
    assert media.strided_frames(16, 32, 61, 2) == [0, 2, 4, 6] and media.strided_frames(4, 4, 4) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        media.strided_frames(4, 16, 16, 2)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3)
    events.write.parquet(str(tmp_path / "in"))
    source = lambda: state.read_stream(spark, str(tmp_path / "in"), events.schema, 1)
    state.run_available(state.event_windows(source(), "ts", "40 days", "1 day", ["event_type"]), str(tmp_path / "w"), str(tmp_path / "cw"))
    state.run_available(source(), str(tmp_path / "o"), str(tmp_path / "co"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == events.count()
    events.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    state.run_available(source(), str(tmp_path / "o"), str(tmp_path / "co"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == events.count() + 5
    assert state.sessions(source(), "ts", "1 day", "1 hour", ["user_id"]).isStreaming
    assert state.merge_progress({"epoch": 1, "sample_in_epoch": 0}, {"epoch": 0, "sample_in_epoch": 9})["epoch"] == 1
    got = state.progress(spark.createDataFrame([("a", 1), ("a", 4)], "consumer string, place long"), "consumer").first()
    assert got.sample_in_epoch == 5


def test_shuffles_begin_with_more_partitions_for_more_rows(spark):
    from lodestream.sources.shared import PARTITION_ROWS, spread

    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(setting)
    try:
        spread(spark, 4 * PARTITION_ROWS)
        assert spark.conf.get(setting, None) is None
        spread(spark, 40 * PARTITION_ROWS + 1)
        assert spark.conf.get(setting) == "41"
        spread(spark, 9 * PARTITION_ROWS)
        assert spark.conf.get(setting) == "41"
    finally:
        spark.conf.unset(setting)


@pytest.mark.parametrize("name", ["chunk_scoped_topk", "chunk_scoped_sql"])
def test_queries_per_chunk_are_not_shuffled_by_file(spark, sf_dir, name):
    from lodestream.plans.queries import QUERIES

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [_file" in plan and "SortMergeJoin [_file" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize(("name", "column", "least", "limit", "chunk"), [("chunk_scoped_topk", "l_extendedprice", 0, 3, 5000), ("chunk_scoped_sql", "l_quantity", 30, 5, 4000)])
def test_queries_per_chunk_sort_a_bounded_number_of_rows(spark, tmp_path, monkeypatch, name, column, least, limit, chunk):
    """One row group cannot be split among tasks, so nothing is sorted before the rows are dealt by chunk."""
    import pandas as pd

    from lodestream.plans.queries import QUERIES

    n = 60_000
    table = pd.DataFrame({"l_quantity": [float(i * 7919 % 50) for i in range(n)], "l_extendedprice": [float(i * 104_729 % 9973) for i in range(n)]})
    table.to_parquet(tmp_path / "lineitem.parquet", index=False, row_group_size=n)
    monkeypatch.setattr(position, "CHUNKED_ROWS", 10_000, raising=False)
    df = QUERIES[name](spark, str(tmp_path))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(lines) if "hashpartitioning(chunk" in line or "hashpartitioning(_chunk" in line)
    assert ", 6), REPARTITION_BY_NUM" in lines[dealt]
    assert not any("WindowGroupLimit" in line or "Sort [chunk" in line or "Sort [_chunk" in line for line in lines[dealt:])
    expected = set()
    for start in range(0, n, chunk):
        rows = [(-v, p) for p, v in zip(range(start, start + chunk), table[column][start : start + chunk], strict=True) if v > least or not least]
        expected |= {(p, -v) for v, p in sorted(rows)[:limit]}
    got = [(r.pos, r[column]) for r in df.collect()]
    assert len(got) == len(expected) and set(got) == expected
