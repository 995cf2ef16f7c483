"""Columns, rankings, run records and the composed steps of a study, on hand-sized tables."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lociforge.functions import frames as R
from lociforge.functions import series as N
from lociforge.operators import cohort as C
from lociforge.operators import expression as X
from lociforge.operators import metrics as M
from lociforge.operators import models as L
from lociforge.operators import pca as P
from lociforge.operators import rankings as K
from lociforge.operators import runs as T
from lociforge.operators import study as S
from lociforge.operators import summaries as U


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    rows = [(k, int(v[0] + 0.1 * rng.random() > 0.55), Vectors.dense(v)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, ["sample_id", "label", "features"]).cache()


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert R.insert_after(df, "a", "x", F.lit(9)).columns == ["a", "x", "b", "c"]
    assert R.without_last(df, 2).columns == ["a"] and R.columns_where(df, lambda c: c == "c", "a").columns == ["a", "c"]


def test_rows_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in df.select(R.row_max("a", "b"), R.row_mean("a", "b"), R.row_std("a", "b")).collect()]
    assert got[0] == (1.0, 1.0, None) and got[1] == (None, None, None) and got[2][:2] == (5.0, 4.0) and abs(got[2][2] - 2**0.5) < 1e-12
    assert [r.name for r in R.filter_counts(df, {"x": F.col("a") > 2, "y": F.col("b") > 9}).where("n = 0").collect()] == ["y"]


def test_orders(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", -0.1)], "id string, v double")
    assert [r.id for r in K.by_significance(df, "v").collect()] == ["c", "a", "b"]
    assert [r.id for r in K.ascending(df, "v", absolute=True).collect()] == ["c", "a", "b"]
    assert [r.id for r in K.extreme_rows(df, 1, "v", "id").collect()] == ["a"] and [r.id for r in K.extreme_rows(df, 1, "v", "id", best=False).collect()] == ["c"]
    ranked = K.in_order_of(df.drop("v"), spark.createDataFrame([("c", 2.0), ("a", 1.0)], "id string, s double"), "id", "s")
    assert [r.id for r in ranked.collect()] == ["c", "a"]
    a, b = K.balanced_by_accuracy(df.withColumnRenamed("v", "accuracy"), df.limit(1).withColumnRenamed("v", "accuracy"), well_a=True)
    assert [r.id for r in a.collect()] == ["c"] and b.count() == 1
    with pytest.raises(ValueError, match="no contrast"):
        K.contrast(df, "x")


def test_ranges_give_what_one_window_gives(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    counts = df.groupBy("v").count()
    up = {r.v: r.s for r in N.running(counts, "v", {"s": "count"}).collect()}
    down = {r.v: r.s for r in N.running(counts, "v", {"s": "count"}, down=True, least=True).collect()}
    each = {x: int((v == x).sum()) for x in set(v.tolist())}
    assert all(up[x] == (v <= x).sum() for x in up) and all(down[x] == min(each[y] for y in each if y >= x) for x in down)
    ranks = sorted((r.v, r.n) for r in N.global_rank(df, "v", "n").collect())
    assert sorted(n for _, n in ranks) == list(range(1, 501)) and [x for x, _ in sorted(ranks, key=lambda r: r[1])] == sorted(v.tolist())
    assert not N.running(counts.limit(0), "v", {"s": "count"}).collect() and not N.global_rank(df.limit(0), "v", "n").collect()


def test_draws_are_dealt_to_parts(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    rows = C.drawn(df, ["g"], "sample_id", 3).collect()
    for g in ("a", None):
        mine = [r for r in rows if r.g == g]
        assert sorted(r._n for r in mine) == list(range(1, 501)) and {r._size for r in mine} == {500}


def test_fuzzy_ids(spark):
    left = spark.createDataFrame([("x-12-y",), ("12",), ("zz",), ("",), (None,), ("7",)], "sample_id string")
    right = spark.createDataFrame([("12",), ("2",), ("",), ("q7q",), (None,)], "genotype_id string")
    assert sorted((r[0], r[1]) for r in C.map_ids(left, right).collect()) == [("", ""), ("12", "12"), ("7", "q7q"), ("x-12-y", "12")]
    plan = C.map_ids(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan


def test_missing_id_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    ids = spark.createDataFrame([(2, 1), (1, 5)], "position int, id int")
    with pytest.raises(Exception, match="no row of 5"):
        C.required_lookup(df, ids, "id").collect()
    assert [r.v for r in C.required_lookup(df, ids.where("id = 1"), "id").collect()] == ["a"]


def test_run_records(spark, tmp_path, fitted):
    path = str(tmp_path / "runs")
    T.log_values(spark, path, "r1", {"f1": 0.5}, {"iteration": 3}, {"a": "true"})
    T.log_values(spark, path, "r2", {"f1": 0.7, "mcc": 0.1})
    runs = T.read_runs(spark, path)
    got = {r.run_id: (r.metrics, r.it) for r in runs.select("*", T.bootstrap_iteration(F.col("params")).alias("it")).collect()}
    assert got == {"r1": ({"f1": 0.5}, 3), "r2": ({"f1": 0.7, "mcc": 0.1}, -1)}
    named = runs.withColumn("run_name", F.col("run_id")).withColumn("run_type", F.lit(None).cast("string"))
    assert [r.run_id for r in named.where(T.run_condition(tags=["a", "b"], exclude=["x"])).collect()] == ["r1"]
    model = L.fit(fitted, "elastic_net")
    T.save_model(model, str(tmp_path / "model"))
    again = T.load_model(str(tmp_path / "model"))
    assert L.predict(again, fitted).orderBy("sample_id").first().y_pred == L.predict(model, fitted).orderBy("sample_id").first().y_pred


def test_models_tell_classes_apart(spark, fitted):
    train, test = fitted.where("sample_id % 3 > 0"), fitted.where("sample_id % 3 = 0")
    for name in ("elastic_net", "naive_bayes", "linear_svc", "gradient_boosting", "random_forest"):
        p = L.predict(L.fit(train, name), test)
        r = p.agg(F.min("y_pred").alias("low"), F.max("y_pred").alias("high"), F.count("*").alias("n")).first()
        assert r.low >= 0 and r.high <= 1 and r.n == test.count() and M.roc_auc(p).first().auc > (0.6 if name == "naive_bayes" else 0.9), name
    found = L.search(train.select("label", "features"), n=2, folds=2)
    assert max(found.avgMetrics) > 0.9
    assert X.mean_threshold_selection(train, ["x", "y", "z"]) == ["x"]
    assert len(P.principal_components(train, 2).first().pca) == 2


def test_values_below_the_training_range(spark):
    train = spark.createDataFrame([(k, k % 2, Vectors.dense([k % 2 + 0.5, 1.0])) for k in range(10)], ["sample_id", "label", "features"])
    test = spark.createDataFrame([(1, 1, Vectors.dense([-5.0, 9.0]))], ["sample_id", "label", "features"])
    assert 0 <= L.predict(L.fit(train, "naive_bayes"), test).first().y_pred <= 1


def test_evaluation_and_bootstraps(spark, fitted):
    done = S.evaluate(fitted.where("sample_id < 200"), fitted.where("sample_id >= 200"), "elastic_net", {"T": fitted.limit(50)}, ["x", "y", "z"])
    m = {(r.dataset, r.table): r for r in done["metrics"].collect()}
    assert set(m) == {("train", None), ("test", None), ("holdout", "T")} and m["test", None].tp + m["test", None].fn + m["test", None].tn + m["test", None].fp == 100
    assert done["importances"].orderBy(F.desc("importance")).first().feature_name == "x" and done["predictions"].count() == 350
    assert S.evaluate(fitted, fitted, "mlp")["importances"] is None
    b = S.bootstrap_models(fitted, ["elastic_net"], 2, 80).collect()
    assert {(r.iteration, r.model_name, r.dataset) for r in b} == {(k, "elastic_net", d) for k in range(2) for d in ("train", "test")}
    assert {r.tp + r.fn + r.tn + r.fp for r in b if r.dataset == "train"} == {80}


def test_preparation_wants_all_samples(spark):
    features = spark.createDataFrame([(1, 0.5)], "sample_id int, f double")
    ids = spark.createDataFrame([(1, 1), (2, 0)], "sample_id int, label int")
    train, test = S.prepare(features, ids.where("sample_id = 1"), ids.where("sample_id = 2"))
    assert [tuple(r) for r in train.collect()] == [(1, 1, 0.5)]
    with pytest.raises(Exception, match="no features of sample 2"):
        test.collect()


def test_overall_metrics(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4, 0.1, 3.0)], "sample_id int, accuracy_a double, accuracy_b double, accuracy_a_std double, log_loss double")
    got = U.overall_metrics(df)
    assert set(got.columns) - set(df.columns) == {"accuracy"} and abs(got.first().accuracy - 0.3) < 1e-12 and U.base_metric("log_loss") == "log"


def test_explanations(spark, fitted):
    got = S.explanation_frame(fitted, "features", ["x", "y", "z"], "sample_id")
    assert got.columns == ["sample_id", "x", "y", "z"] and got.count() == 300
