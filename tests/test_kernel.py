"""The kernel classifier against an exact kernel machine in numpy, and its probabilities against the truth."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lociforge.operators import kernel as K


def rings(n, seed):
    """Two classes that no plane tells apart; a tenth of the labels is wrong."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x**2).sum(1) + 0.4 * np.sin(3 * x[:, 0]) > 2.4).astype(int)
    return x, np.where(rng.random(n) < 0.1, 1 - y, y)


def frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + k, int(b), Vectors.dense(v)) for k, (v, b) in enumerate(zip(x, y, strict=True))], ["sample_id", "label", "features"])


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def exact_machine(k, y, penalty, rounds=30):
    """Squared-hinge support vector machine on a whole kernel matrix, by Newton's method."""
    t, n = 2.0 * y - 1, len(y)
    a, b = np.zeros(n), 0.0
    for _ in range(rounds):
        inside = np.flatnonzero(t * (k @ a + b) < 1)
        m = np.zeros((len(inside) + 1, len(inside) + 1))
        m[:-1, :-1] = k[np.ix_(inside, inside)] + np.eye(len(inside)) / (2 * penalty)
        m[:-1, -1] = m[-1, :-1] = 1
        solved = np.linalg.solve(m, np.append(t[inside], 0))
        new = np.zeros(n)
        new[inside], b = solved[:-1], solved[-1]
        done, a = np.allclose(new, a, atol=1e-9), new
        if done:
            break
    return a, b


def test_against_the_exact_kernel(spark):
    x, y = rings(2000, 1)
    z, truth = rings(1500, 2)
    train, test = frame(spark, x, y).repartition(2).cache(), frame(spark, z, truth, 5000)
    model = K.fit_kernel(train, landmarks=200)
    got = {r.sample_id: r for r in model.predict(test).collect()}
    p, score = (np.array([got[5000 + k][c] for k in range(1500)]) for c in ("y_pred", "score"))
    m = model.map
    whole = K.kernel(m.scaled(x), m.scaled(x), m.gamma)
    a, b = exact_machine(whole, y, 1.0)
    exact = K.kernel(m.scaled(z), m.scaled(x), m.gamma) @ a + b
    assert abs(auc(p, truth) - auc(exact, truth)) < 0.01 and auc(p, truth) > 0.85
    brier = lambda q: ((q - truth) ** 2).mean()
    raw = 1 / (1 + np.exp(-score))
    assert brier(p) < brier(raw)
    for low, high in ((0, 0.3), (0.7, 1.0)):  # what is called likely is so
        some = (p >= low) & (p < high)
        assert some.sum() > 100 and abs(p[some].mean() - truth[some].mean()) < 0.06


def test_features_equal_the_kernel_on_landmarks(spark):
    x, y = rings(60, 3)
    m = K.nystroem(frame(spark, x, y), landmarks=60)
    f = m.features(x)
    assert np.allclose(f @ f.T, K.kernel(m.scaled(x), m.scaled(x), m.gamma), atol=1e-6)


def test_edges(spark):
    rows = [(k, k % 2, Vectors.dense([float(k % 2), 5.0])) for k in range(40)] + [(98, None, Vectors.dense([1.0, 5.0])), (99, 1, None)]
    df = spark.createDataFrame(rows, ["sample_id", "label", "features"])
    model = K.fit_kernel(df, landmarks=1000, n_folds=3)
    got = {r.sample_id: r.y_pred for r in model.predict(df).collect() if r.y_pred is not None}
    assert 99 not in got and got[1] > 0.5 > got[0] and got[98] == pytest.approx(got[1])
