import zlib

import numpy as np

from lodestream.llm import quality_model
from lodestream.llm.quality_model import pool


def test_pool_adjacent_violators():
    assert pool(np.ones(5), np.array([1.0, 3, 2, 2, 5])).tolist() == [1, 7 / 3, 7 / 3, 7 / 3, 5]
    out = pool(np.array([1.0, 2, 1]), np.array([3.0, 2, 1]))
    assert np.allclose(out, 2.0)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_model.apply(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_held_out_labels_are_never_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F

    changed = labels.withColumn("quality", F.when(quality_model.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 6) for r in quality_model.apply(docs, x).collect()} for x in (labels, changed))
    assert a == b and len(a) == docs.count()


def test_odd_rows(spark, corpus_rows):
    df = spark.createDataFrame(corpus_rows, "doc_id long, text string").selectExpr("*", "1 as quality", "'x' as fold")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.apply(df, labels).collect()
    assert len(out) == len(corpus_rows) and all(0 <= r.score <= 1 for r in out)
    one = labels.where("quality = 1")
    assert {r.score for r in quality_model.apply(df, one).collect()} == {0.5}
    assert quality_model.apply(df.limit(0), labels).collect() == []
    assert quality_model.good(df, labels).columns == df.columns


def test_equals_a_plain_fit(spark):
    """Scores of every document against one matrix of all training rows, least squares and a simple monotone fit, without Spark."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [(r.doc_id, r.quality, zlib.crc32(str(r.doc_id).encode()) % 5) for r in labels.collect()]
    train = [x for x in train if x[2] and x[0] in texts]

    def measured(ids):
        out = []
        for i in ids:
            data = np.frombuffer((texts[i] or "").encode(), np.uint8)
            out.append(quality_model.features(data, np.array([0, len(data)]))[0])
        return np.array(out)

    x, y, fold = measured([t[0] for t in train]), np.array([t[1] for t in train]), np.array([t[2] for t in train])
    fit = fold != 4
    cosines = quality_model.Cosines(x[fit].mean(0), x[fit].std(0), quality_model.N_COSINES, quality_model.WIDTH, quality_model.SEED)
    phi = cosines(x[fit])
    # ridge regression as least squares with one more row per weight
    beta = np.linalg.lstsq(np.concatenate([phi, np.sqrt(quality_model.RIDGE) * np.eye(phi.shape[1])]), np.concatenate([2.0 * y[fit] - 1, np.zeros(phi.shape[1])]), rcond=None)[0]
    raw = lambda z: np.clip((cosines(z) @ beta + 1) / 2, 0, 1)
    bins = np.minimum((raw(x[~fit]) * quality_model.BINS).astype(int), quality_model.BINS - 1)
    at = np.unique(bins)
    share = [y[~fit][bins == b] for b in at]
    # the isotonic fit in its min-max form: the largest mean over starts up to here of the smallest mean over ends from here on
    mean = lambda a, b: np.concatenate(share[a : b + 1]).mean()
    to = [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    ids = sorted(texts)
    score = raw(measured(ids))
    want = np.clip(0.98 * np.interp(score, (at + 0.5) / quality_model.BINS, to) + 0.02 * score, 0, 1)
    got = {r.doc_id: r.score for r in quality_model.apply(docs, labels).collect()}
    assert len(got) == len(ids)
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)
