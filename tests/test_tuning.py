"""The search by a surrogate: against random search on known functions, spaces, and one search on Spark."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lociforge.operators import tuning as T

SPACE = {"rate": ("log", 1e-6, 1e-1), "depth": ("int", 3, 10), "share": ("real", 0, 1)}


def known(v):
    """Highest (1) at a rate of 1e-3, a depth of 6 and a share of 0.3."""
    return math.exp(-((math.log10(v["rate"]) + 3) ** 2) / 2 - (v["depth"] - 6) ** 2 / 8 - (v["share"] - 0.3) ** 2 / 0.1)


def random_search(n, seed):
    rng = np.random.default_rng(seed)
    return max(known(T.values_of(p, SPACE)) for p in rng.random((n, 3)))


def test_beats_random_search():
    ours = [max(s for _, s in T.maximise(lambda many: [known(v) for v in many], SPACE, 30, seed=k)) for k in range(6)]
    theirs = [random_search(30, 100 + k) for k in range(6)]
    assert np.mean(ours) > np.mean(theirs) + 0.05 and min(ours) > 0.85


def test_values_stay_in_their_space():
    seen = T.maximise(lambda many: [known(v) if v["depth"] < 9 else math.nan for v in many], SPACE, 23, batch=5, seed=3)
    assert len(seen) == 23
    for v, _ in seen:
        assert 1e-6 <= v["rate"] <= 1e-1 and v["depth"] in range(3, 11) and 0 <= v["share"] <= 1
    whole = T.maximise(lambda many: [v["k"] for v in many], {"k": ("int", 1, 5)}, 5, batch=1, first=1, seed=1)
    assert sorted(v["k"] for v, _ in whole) == [1, 2, 3, 4, 5]  # none twice while there are others
    assert [s for _, s in T.maximise(lambda many: [math.nan] * len(many), SPACE, 3)] != []


def test_process_meets_its_points():
    rng = np.random.default_rng(2)
    x = rng.random((20, 2))
    y = np.sin(5 * x[:, 0]) + x[:, 1]
    mean, sd = T.Process(x, y).at(x)
    assert np.abs(mean - y).max() < 0.1 and sd.max() < 0.2
    far, wide = T.Process(x[:5], y[:5]).at(np.array([[9.0, 9.0]]))
    assert wide[0] > sd.max()
    assert T.improvement(np.array([1.0]), np.array([1e-9]), 0.0)[0] == pytest.approx(1.0) and T.improvement(np.array([0.0]), np.array([1.0]), 0.0)[0] == pytest.approx(1 / math.sqrt(2 * math.pi))


@pytest.mark.parametrize("name", sorted(T.SPACES))
def test_every_model_has_its_space(spark, name):
    rng = np.random.default_rng(4)
    for p in rng.random((5, len(T.SPACES[name]))):
        assert T.estimator(name, T.values_of(p, T.SPACES[name]), 100, 3) is not None


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.random((240, 3))
    rows = [(k, int(v[0] + 0.3 * rng.random() > 0.65), Vectors.dense(v)) for k, v in enumerate(x)]
    train = spark.createDataFrame(rows, ["sample_id", "label", "features"]).cache()
    train.count()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    model, tried = T.search(train, "elastic_net", n=6, n_folds=3, batch=3)
    got = tried.collect()
    assert len(got) == 6 and [r.auc for r in got] == sorted((r.auc for r in got), reverse=True) and {r.folds for r in got} == {3}
    assert got[0].auc > 0.9 and model.transform(train).where("prediction = label").count() > 190
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_searches_of_labels_by_chance(spark, tmp_path):
    """Held-out areas may all lie below a half where features tell nothing: the query is still what its SQL says."""
    import duckdb

    from lociforge.plans import catalogue

    rng, n = np.random.default_rng(0), 60
    x = [(k, *map(float, v)) for k, v in enumerate(rng.random((n, 4)))]
    y = [(k, float(v)) for k, v in enumerate(rng.permutation(np.repeat([1e5, 2e5], n // 2)))]
    spark.createDataFrame(x, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(y, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    catalogue.load()
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, catalogue.QUERIES["searched_models"](spark, str(tmp_path)).collect())) == sorted(duck.execute(catalogue.SQL["searched_models"]).fetchall())
