"""The horseshoe selector: slopes against differences, planted effects, saving, the validation table, edges."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lociforge.operators import horseshoe as H
from lociforge.operators import selection as L


def log_joint(theta, x, y):
    d = x.shape[1]
    z = x @ H.weights(theta[None])[0] + theta[-1]
    lik = (y * z - np.log1p(np.exp(z))).sum()
    u, v, t = theta[d : 2 * d], theta[2 * d : 3 * d], theta[3 * d]
    prior = -0.5 * (theta[:d] ** 2).sum() + (u - np.log1p(np.exp(2 * u))).sum() + (-v - np.exp(-v)).sum() + t - np.log1p(np.exp(2 * t)) - theta[-1] ** 2 / 200
    return lik + prior


def test_slopes_against_differences():
    rng = np.random.default_rng(1)
    x, y, theta = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.normal(size=14)
    r = y - 1 / (1 + np.exp(-(x @ H.weights(theta[None])[0] + theta[-1])))
    got = H.joint_slopes(theta[None], (r @ x)[None], np.array([r.sum()]))[0]
    for k in range(14):
        step = np.zeros(14)
        step[k] = 1e-6
        assert got[k] == pytest.approx((log_joint(theta + step, x, y) - log_joint(theta - step, x, y)) / 2e-6, rel=1e-5, abs=1e-5)


def test_entropy_slopes():
    rng = np.random.default_rng(2)
    q = H.LowRankNormal(rng.normal(size=5), rng.normal(size=5), rng.normal(size=(5, 2)))
    cov = np.diag(np.exp(2 * q.p["s"])) + q.p["v"] @ q.p["v"].T
    assert q.entropy() == pytest.approx(0.5 * np.linalg.slogdet(cov)[1])
    got = q.slopes(np.zeros((1, 5)), np.zeros((1, 5)), np.zeros((1, 2)))
    for k in ("s", "v"):
        for at in np.ndindex(q.p[k].shape):
            q.p[k][at] += 1e-6
            up = q.entropy()
            q.p[k][at] -= 2e-6
            down = q.entropy()
            q.p[k][at] += 1e-6
            assert got[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    drawn = q.draw(rng, 200_000)[0]
    assert np.allclose(np.cov(drawn.T), cov, atol=0.1 * np.abs(cov).max())


NAMES = [f"g{k:03d}" for k in range(200)]
PLANTED = [3, 40, 41, 77, 120, 150, 188, 199]


@pytest.fixture(scope="module")
def study(spark):
    """1200 samples of 200 features in correlated blocks of five; eight have effects of several sizes."""
    rng = np.random.default_rng(5)
    common = rng.normal(size=(1200, 40)).repeat(5, 1)
    x = 0.7 * common + 0.7 * rng.normal(size=(1200, 200))
    beta = np.zeros(200)
    beta[PLANTED] = [0.9, -0.8, 0.8, 0.6, -0.6, 0.5, 0.5, -0.7]
    y = rng.random(1200) < 1 / (1 + np.exp(-(x @ beta - 0.3)))
    rows = [(k, int(b), v.tolist()) for k, (v, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, label int, x array<double>").withColumn("features", array_to_vector("x")).repartition(4).cache()


@pytest.fixture(scope="module")
def model(study):
    return H.HorseshoeSelector(maxEpochs=60).fit(study)


def recall(effects, false_ones):
    """Planted features found before so many others come in the order of effects."""
    order = [int(r.feature_name[1:]) for r in effects.orderBy(F.desc("effect_size"), "feature_name").collect()]
    others = [i for i, k in enumerate(order) if k not in PLANTED][false_ones]
    return sum(k in PLANTED for k in order[:others]) / len(PLANTED)


def mean_field(spark, study, epochs=60, rate=0.05):
    """Effects under a mean-field normal posterior with a heavy-tailed prior on each weight, by whole-batch gradients in numpy."""
    rows = study.select("x", "label").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    x = (x - x.mean(0)) / (x.max(0) - x.min(0))
    rng, n = np.random.default_rng(42), x.shape[1]
    m, s, b, gm, gs, gb = np.zeros(n), np.full(n, -2.0), 0.0, 1e-8, 1e-8, 1e-8
    for _ in range(epochs):
        e = rng.normal(size=n)
        w = m + np.exp(s) * e
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = x.T @ r + 2 * w / (0.1 + w * w)
        ds = g * e * np.exp(s) - 1
        gm, gs, gb = gm + g * g, gs + ds * ds, gb + r.sum() ** 2
        m, s, b = m - rate * 4 * g / np.sqrt(gm), np.clip(s - rate * ds / np.sqrt(gs), -6, 2), b - rate * r.sum() / np.sqrt(gb)
    return spark.createDataFrame([(f, float(abs(v))) for f, v in zip(NAMES, m / np.exp(s), strict=True)], "feature_name string, effect_size double")


def test_planted_effects(spark, study, model):
    ours, theirs = L.effect_sizes(model.draws(spark, NAMES, 500)).cache(), mean_field(spark, study)
    assert recall(ours, 0) == recall(theirs, 0) == 1.0
    by = {r.feature_name: r for r in ours.collect()}
    assert by["g003"].beta_mean > 0 > by["g040"].beta_mean
    # what the horseshoe is for: weights without an effect are shrunk, those with one hardly
    noise = lambda size: np.mean([size[n] for k, n in enumerate(NAMES) if k not in PLANTED]) / np.mean([size[NAMES[k]] for k in PLANTED])
    assert noise({n: abs(r.beta_mean) for n, r in by.items()}) < 0.1
    assert noise({n: r.effect_size for n, r in by.items()}) < noise({r.feature_name: r.effect_size for r in theirs.collect()})


def test_saved_and_loaded(study, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = H.HorseshoeModel.load(str(tmp_path / "m"))
    a, b = (m.transform(study).select("sample_id", "probability", "prediction").orderBy("sample_id").collect() for m in (model, again))
    assert a == b and all(0 <= r.probability <= 1 and r.prediction == (r.probability >= 0.5) for r in a)
    labels = dict(study.select("sample_id", "label").collect())
    assert np.mean([labels[r.sample_id] == r.prediction for r in a]) > 0.75
    est = H.HorseshoeSelector(maxEpochs=3, rank=2)
    est.save(str(tmp_path / "e"))
    assert H.HorseshoeSelector.load(str(tmp_path / "e")).getOrDefault("rank") == 2


def test_validation_table(study, model):
    got = model.validation_table(study, n=50).collect()
    held = study.where(model.held_out(F.col("x"))).select("sample_id").collect()
    assert {r.sample_id for r in got} == {r.sample_id for r in held} and 150 < len(got) < 330
    for r in got:
        right = r.avg_prediction if r.label else 1 - r.avg_prediction
        assert r.accuracy == pytest.approx(right) and r.draw_count == 50
        assert r.accuracy_std == pytest.approx((right * (1 - right) / 50) ** 0.5) and r.prediction_std == pytest.approx((right * (1 - right)) ** 0.5)
    assert np.mean([r.accuracy for r in got]) > 0.65


def test_edges(spark):
    rows = [(k, k % 2, [1.0, float(k % 2), float(k % 7)]) for k in range(60)] + [(60, None, [1.0, 0.0, 0.0]), (61, 1, None)]
    df = spark.createDataFrame(rows, "sample_id long, label int, features array<double>")
    m = H.HorseshoeSelector(maxEpochs=15, heldOut=0.0, slices=2).fit(df)
    assert m.getOrDefault("loss") == -1.0
    got = {r.sample_id: r for r in m.transform(df).collect()}
    assert got[1].prediction == 1.0 and got[0].prediction == 0.0 and got[61].probability is None
    assert m.validation_table(df).count() == 0
    with pytest.raises(ValueError):
        H.HorseshoeSelector().fit(df.limit(0))
    vectors = df.withColumn("features", F.when(F.col("features").isNotNull(), array_to_vector("features")))
    again = {r.sample_id: r for r in H.HorseshoeSelector(maxEpochs=15, heldOut=0.0, slices=2).fit(vectors).transform(vectors).collect()}
    assert again[61].probability is None and again[1].prediction == 1.0


def test_selector_takes_all_samples(spark, monkeypatch):
    from lociforge.plans.catalogue import Tables, learning

    seen = []
    monkeypatch.setattr(learning.H, "bayesian_selector", lambda s, *a: seen.append(s) or s.selectExpr("'f' AS feature_name", "quantity AS beta"))
    t = Tables(spark, "/root/testdata/sf0.001")
    learning.horseshoe_selector(t)
    assert seen[0].count() == learning.samples(t).count() and seen[0].select("iteration").distinct().count() == 5


def test_fits_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(4).random((400, 3))
    df = spark.createDataFrame([(k % 2, int(v[1] > 0.6), *map(float, v)) for k, v in enumerate(x)], "iteration int, label int, f0 double, f1 double, f2 double")
    one, many = (H.bayesian_selector(df.repartition(p), ["f0", "f1", "f2"], maxEpochs=5) for p in (1, 7))
    assert "FlatMapGroups" not in many._jdf.queryExecution().toString()
    means = [{(r.iteration, r.feature_name): r.m for r in d.groupBy("iteration", "feature_name").agg(F.avg("beta").alias("m")).collect()} for d in (one, many)]
    assert len(means[0]) == 6 and all(np.isclose(means[0][k], means[1][k], rtol=1e-5, atol=1e-7) for k in means[0])


def test_small_fits_are_one_task(spark, monkeypatch):
    """A fit of few bytes takes a handful of jobs, not one a step, and finds what the fit of a job a step finds."""
    x = np.random.default_rng(6).random((600, 3))
    df = spark.createDataFrame([(int(v[0] > 0.5), v.tolist()) for v in x], "label int, features array<double>").repartition(3)

    def fitted(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            m = H.HorseshoeSelector(maxEpochs=6).fit(df)
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return [m.getOrDefault(k) for k in ("loc", "logScales", "factors", "loss")], len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    here, few = fitted("few")
    monkeypatch.setattr(H, "SMALL", 0)
    spread, many = fitted("many")
    assert few < 12 < 24 <= many
    assert all(np.allclose(a, b, rtol=1e-5, atol=1e-7) for a, b in zip(here, spread, strict=True))
