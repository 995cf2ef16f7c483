"""Constants, ties, single classes and few points: defined results, no errors."""

import math

import numpy as np
import pytest

from lociforge.functions import series as N
from lociforge.operators import metrics as S
from lociforge.operators import runs as R
from lociforge.operators import selection as L
from lociforge.operators.expression import _two_sided
from pyspark.sql import functions as F


def density(values, grid=50, neighbours=10):
    v = np.array(values, float)
    span = v.max() - v.min()
    h = [max(sorted(abs(v - x))[1:][: neighbours - 1] or [0.0]) for x in v]
    h = np.maximum(h, 1e-6 * (span or 1.0))
    x = v.min() + span * np.arange(grid) / (grid - 1)
    return [(np.exp(-0.5 * ((g - v) / h) ** 2) / (h * math.sqrt(2 * math.pi))).mean() for g in x]


@pytest.mark.parametrize("values", [[3.0] * 10, [1.0] * 12 + [2.0, 5.0], [1.0, 2.0, 4.0], [7.0], list(range(30))])
def test_density_of_ties_and_few_points(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    got = [r.density for r in L.adaptive_kde(df, grid=50).orderBy("k").collect()]
    assert np.allclose(got, density(values))
    assert L.tail_threshold(L.adaptive_kde(df, grid=50)).count() == 1


def test_density_of_nothing(spark):
    assert L.adaptive_kde(spark.createDataFrame([], "x double")).where("density is not null").count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_curves_of_one_class(spark, label):
    df = spark.createDataFrame([(label, 0.2), (label, 0.2), (label, 0.7)], "label int, y_pred double")
    assert S.roc_auc(df).first().auc is None
    assert S.average_precision(df).first().ap == (1.0 if label else None)
    roc = {r.threshold: (r.fpr, r.tpr) for r in S.roc_curve(df).collect()}
    assert roc == ({0.7: (None, 1 / 3), 0.2: (None, 1.0)} if label else {0.7: (1 / 3, None), 0.2: (1.0, None)})
    assert {r.recall for r in S.pr_curve(df).collect()} == ({1 / 3, 1.0} if label else {None})
    runs = df.withColumn("run_id", F.lit(1)).unionByName(spark.createDataFrame([(0, 0.1, 2), (1, 0.9, 2)], "label int, y_pred double, run_id int"))
    assert {r.tpr for r in S.mean_roc(runs).collect()} == {1.0}


def test_histograms(spark):
    df = spark.createDataFrame([(2.5,)] * 4 + [(None,)], "x double")
    got = [(r.left, r.density) for r in N.histogram(df, "x", 10).orderBy("bin").collect()]
    counts, edges = np.histogram([2.5] * 4, bins=10, density=True)
    assert np.allclose([d for _, d in got], counts) and np.allclose([e for e, _ in got], edges[:-1])
    assert N.histogram(df.limit(0), "x", 10).count() == 0


def test_probabilities_are_at_most_one(spark):
    got = [r.p for r in spark.createDataFrame([(0.0,), (1e-9,), (1.0,), (40.0,)], "z double").select(_two_sided(F.col("z")).alias("p")).collect()]
    assert got[:2] == [1.0, 1.0] and got[2] == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-6) and 0 <= got[3] < 1e-300


def test_last_value_of_a_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    R.log_values(spark, path, "a", {"loss": 3.0}, {"depth": 10}, step=1)
    R.log_values(spark, path, "a", {"loss": 1.0}, {"depth": 9}, {"done": "x"}, step=2)
    R.log_values(spark, path, "a", {"loss": 2.0}, step=1)
    R.log_values(spark, path, "b", {"loss": 5.0})
    R.log_values(spark, path, "b", {"loss": 4.0})
    got = {r.run_id: r for r in R.read_runs(spark, path).collect()}
    assert got["a"].metrics == {"loss": 1.0} and got["a"].params == {"depth": "9"} and got["a"].tags == {"done": "x"}
    assert got["b"].metrics == {"loss": 4.0}
