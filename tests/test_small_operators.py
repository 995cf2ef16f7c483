"""Small operators on nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.functions.frames import merged_maps
from lociforge.operators import horseshoe as H
from lociforge.operators import cohort as C
from lociforge.operators import expression as X
from lociforge.operators import metrics as M
from lociforge.operators import models as L
from lociforge.operators import rankings as R
from lociforge.operators import selection as V
from lociforge.operators import summaries as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_presence_of_data(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, other_key string")
    other = spark.createDataFrame([(1,), (1,), (None,)], "o int")
    assert rows(C.with_data(df, other, "k", "o")) == [(1, "a")]
    assert rows(C.without_data(df, other, "k", "o")) == [(2, "b"), (None, "c")]
    assert rows(C.without_data(df, other.limit(0), "k", "o")) == rows(df)


def test_tails(spark):
    df = spark.createDataFrame([(0.1,), (0.15,), (0.5,), (0.85,), (None,)], "p double")
    assert rows(C.tails(df, "p")) == [(0.1, "low"), (0.15, "low"), (0.85, "high")]


def test_random_members(spark):
    members = spark.createDataFrame([(g, f"{g}{k}") for g in "abc" for k in range(5)], "g string, m string")
    groups = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "g string")
    got = rows(C.random_members(groups, members, "g", "m", 2, 7))
    assert len(got) == 2 and all(m[0] == g for g, m in got) and got == rows(C.random_members(groups, members.repartition(3), "g", "m", 2, 7))


def test_melt_and_metric_maps(spark):
    df = spark.createDataFrame([(1, 0.5, None)], "id int, a double, b double")
    assert rows(S.melted(df, ["id"], ["a", "b"])) == [(1, "a", 0.5), (1, "b", None)]
    long = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "run_id int, key string, value double")
    assert rows(S.metric_maps(long)) == [(1, {"a": 2.0, "b": 3.0}, 3)]


def test_class_shares_and_descriptions(spark):
    df = spark.createDataFrame([("s", 0, 0.0), ("s", 0, 1.0), ("t", 1, None), ("u", None, 2.0)], "sample_id string, label int, y_pred double")
    assert rows(M.class_distribution(df)) == [(0, 2, 0.5), (1, 1, 0.25), (None, 1, 0.25)]
    assert rows(M.class_distribution(df.limit(0))) == []
    assert rows(M.mean_probability(df, ["label"])) == [(0, 0.5, 1), (1, None, 1), (None, 2.0, 1)]
    one = M.described(df, "y_pred").first()
    assert (one.n, one.mean, one.low, one.q2, one.high) == (3, 1.0, 0.0, 1.0, 2.0) and M.described(df.limit(0), "y_pred").first().n == 0


def test_varying_and_regulated(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "feature string, v double")
    assert rows(V.varying(f)) == [("a", 1.0)] and rows(V.varying(f, least=1.0)) == []
    g = spark.createDataFrame([(1.0, 0.01), (-1.0, 0.01), (2.0, 0.5), (2.0, None), (0.0, 0.01)], "log2_fold_change double, padj double")
    assert X.regulated_counts(g).first()[:] == (1, 1)


def test_stratum_counts(spark):
    d = spark.createDataFrame([(1, "f"), (1, "f"), (2, "f"), (2, "m")], "draw int, sex string")
    assert rows(X.stratum_counts(d, "draw", ["sex"])) == [("f", 1.5, 0.5, 1), ("m", 1.0, 0.0, 1)]


def test_all_but_last_and_top(spark):
    df = spark.createDataFrame([(3, "x", -5.0), (1, "x", 5.0), (None, "a", 0.0), (2, "x", 9.0)], "n int, g string, v double")
    assert rows(R.all_but_last(df.select("n"), 2, "n")) == [(1,), (2,)]
    assert rows(R.all_but_last(df.select("n"), 9, "n")) == []
    assert [r.n for r in R.top_by(df, 3, "g", "v", "n").collect()] == [None, 2, 1]


def test_merged_maps(spark):
    df = spark.sql("SELECT map('x', 'a', 'y', 'a') AS l, map('y', 'b') AS r UNION ALL SELECT map('x', 'a'), NULL")
    assert [r.m for r in df.select(merged_maps(F.col("l"), F.col("r")).alias("m")).collect()] == [{"x": "a", "y": "b"}, {"x": "a"}]


@pytest.mark.parametrize("held_out", [0.0, 0.3])
def test_selector_ends_early_and_without_held_out_rows(spark, held_out):
    df = spark.range(200).select((F.col("id") % 2).alias("iteration"), (F.col("id") % 7 > 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("f0"), (F.col("id") % 5).cast("double").alias("f1"))
    got = H.bayesian_selector(df, ["f0", "f1"], draws=50, maxEpochs=20, heldOut=held_out, patience=3).groupBy("iteration", "feature_name").agg(F.avg("beta").alias("b"))
    means = {(r.iteration, r.feature_name): r.b for r in got.collect()}
    assert len(means) == 4 and all(means[k, "f0"] > abs(means[k, "f1"]) for k in (0, 1))


@pytest.mark.parametrize("block", [2000, 7])
def test_neighbours_of_many_batches(spark, block):
    """Batches of three training rows, so that the best are merged again and again, ties by id among them; blocks of queries."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (200, 2)).astype(float)
    train = spark.createDataFrame([(k, v.tolist(), int(k % 3 == 0)) for k, v in enumerate(x)], "id long, embedding array<double>, label int").repartition(3)
    test = spark.createDataFrame([(1000 + k, v.tolist()) for k, v in enumerate(rng.normal(1, 1, (20, 2)))], "id long, embedding array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r.id: r.p1 for r in L.knn(train, test, 5, block=block).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for r in test.collect():
        near = sorted((round(float(((v - np.array(r.embedding)) ** 2).sum()), 9), k) for k, v in enumerate(x))[:5]
        assert got[r.id] == pytest.approx(np.mean([k % 3 == 0 for _, k in near]))
    assert L.knn(train, test.limit(0)).count() == L.knn(train.limit(0), test).count() == 0
