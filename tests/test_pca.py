"""Principal components against numpy: wide sparse rows, dense ones, arrays, nulls."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lociforge.operators import pca as P


def exact(x, k):
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    return vt[:k].T, s[:k] ** 2 / (len(x) - 1)


def angle(a, b):
    """The largest angle between the spaces of two bases."""
    return np.arccos(np.clip(np.linalg.svd(a.T @ b)[1].min(), -1, 1))


def test_wide_sparse_rows(spark):
    """100,000 columns, of which a row has some 500; four components stand out."""
    rng = np.random.default_rng(3)
    n, d = 150, 100_000
    of, rows = rng.integers(0, 5, n), []
    for k in range(n):
        own = np.arange(of[k] * 300, of[k] * 300 + 300)
        at = np.unique(np.concatenate([own[rng.random(300) < 0.9], rng.integers(0, d, 200)]))
        rows.append((k, Vectors.sparse(d, at.tolist(), rng.integers(1, 3, len(at)).astype(float).tolist())))
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    x = np.array([r[1].toArray() for r in rows])
    means, v, variances = P.components(df, 4)
    want, true = exact(x, 4)
    assert np.allclose(means, x.mean(0)) and np.allclose(v.T @ v, np.eye(4))
    assert angle(v, want) < 1e-3 and np.allclose(variances, true, rtol=1e-6)
    got = {r.id: r.pca.toArray() for r in P.principal_components(df, 4).collect()}
    assert np.allclose([got[k] for k in range(n)], (x - x.mean(0)) @ v)


@pytest.mark.parametrize("kind", ["vector", "array"])
def test_dense_rows(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 7
    rows = [(k, Vectors.dense(v) if kind == "vector" else v.tolist()) for k, v in enumerate(x)] + [(999, None)]
    schema = None if kind == "vector" else "id long, features array<double>"
    df = spark.createDataFrame(rows, schema or ["id", "features"])
    _, v, variances = P.components(df, 3)
    want, true = exact(x, 3)
    assert angle(v, want) < 1e-6 and np.allclose(variances, true)
    assert (v[np.abs(v).argmax(0), range(3)] > 0).all()
    got = {r.id: r.pca for r in P.principal_components(df, 9).collect()}
    assert got[999] is None and len(got[0]) == 6


def test_edges(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0]))], ["id", "features"])
    assert P.principal_components(df, 2).first().pca.toArray().tolist() == [0.0]
    with pytest.raises(ValueError):
        P.components(df.limit(0))
