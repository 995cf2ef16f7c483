"""Mutual information by neighbours against a quadratic numpy version."""

import numpy as np
import pytest

from lociforge.operators import neighbours as B


def digamma(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def brute(x, y, k):
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.nextafter(np.sort(d, 1)[:, k - 1], 0)[:, None]
    nx, ny = (dx <= r).sum(1), (dy <= r).sum(1)
    return max(0.0, digamma(len(x)) + digamma(k) - np.mean([digamma(a) + digamma(b) for a, b in zip(nx, ny, strict=True)]))


def shapes(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    yield x, 0.8 * x + 0.6 * rng.normal(size=n)
    yield x, rng.permutation(np.tile([-1.0, 1.0], n // 2))  # equal coordinates; a deviation of 1, so that scaling rounds nothing
    yield np.append(rng.exponential(size=n - 3), [80.0, 90.0, 1e4]), np.append(rng.random(n - 3), [5.0, -70.0, 3.0])  # points far away
    yield np.repeat(x[: n // 4], 4), np.repeat(x[: n // 4] ** 2, 4)  # copies of points
    yield np.zeros(n), x


@pytest.mark.parametrize("which", range(5))
@pytest.mark.parametrize("k, block", [(3, 60), (3, None), (12, 45)])
def test_against_numpy(spark, which, k, block):
    n = 2000 if block is None else 400
    x, y = list(shapes(n, 7))[which]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0), (-2, 2.0, None)], "id long, a double, b double").repartition(3)
    assert B.mutual_information(df, "a", "b", k, block=block).first().mi == pytest.approx(brute(x, y, k), abs=1e-10)


def test_few_rows(spark):
    df = spark.createDataFrame([(k, float(k), float(k * k)) for k in range(4)], "id long, a double, b double")
    assert B.mutual_information(df, "a", "b", 4).first().mi is None
    assert B.mutual_information(df, "a", "b", 3).first().mi is not None
    assert B.mutual_information(df.limit(0), "a", "b").first().mi is None
