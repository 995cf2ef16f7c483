"""Negative binomial regression against a plain maximisation of the likelihood, gene by gene."""

import math

import numpy as np
import pytest

from lociforge.operators import glm as G


def study(genes=40, n=24, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), np.arange(n) % 2, rng.integers(0, 2, n), rng.normal(size=n)])
    s = rng.uniform(0.5, 2, n)
    b = np.column_stack([rng.uniform(2, 6, genes), rng.normal(0, 1, genes), rng.normal(0, 0.5, genes), rng.normal(0, 0.3, genes)])
    a = rng.uniform(0.05, 1.0, genes)
    mu = s * np.exp(b @ x.T)
    y = rng.negative_binomial(1 / a[:, None], 1 / (1 + a[:, None] * mu)).astype(float)
    return x, s, b, y


def loglik(b, a, y, s, x):
    mu, r = s * np.exp(x @ b), 1 / a
    return sum(math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) + v * math.log(a * m) - (v + r) * math.log1p(a * m) for v, m in zip(y, mu, strict=True))


def dense_maximum(y, s, x):
    """Newton's method on all coefficients and the dispersion's logarithm together, by differences."""
    t = np.append(np.linalg.lstsq(x, np.log(y / s + 0.5), rcond=None)[0], math.log(0.3))
    f = lambda t: loglik(t[:-1], math.exp(t[-1]), y, s, x)
    k, e = len(t), 1e-4
    for _ in range(200):
        eye = np.eye(k) * e
        g = np.array([(f(t + eye[i]) - f(t - eye[i])) / (2 * e) for i in range(k)])
        h = np.array([[(f(t + eye[i] + eye[j]) - f(t + eye[i] - eye[j]) - f(t - eye[i] + eye[j]) + f(t - eye[i] - eye[j])) / (4 * e * e) for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h - (max(np.linalg.eigvalsh(h)[-1], -1e-3) + 1e-3) * np.eye(k), -g)
        scale = 1.0
        while f(t + scale * step) < f(t) and scale > 1e-6:
            scale /= 2
        t = t + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return t, g


def test_maximum_likelihood():
    x, s, _, y = study()
    b, a = G.fit(y, s, x, adjusted=False, rounds=60)
    inner = [k for k in range(len(y)) if 1e-3 < a[k] < 10]
    assert len(inner) >= 30
    for k in inner[:12]:
        t, _ = dense_maximum(y[k], s, x)
        assert loglik(b[k], a[k], y[k], s, x) >= loglik(t[:-1], math.exp(t[-1]), y[k], s, x) - 1e-9
        assert b[k] == pytest.approx(t[:-1], abs=1e-6) and math.log(a[k]) == pytest.approx(t[-1], abs=2e-5)
    for k in range(len(y)):  # the slopes by the coefficients are 0 everywhere
        mu = s * np.exp(x @ b[k])
        assert np.abs(x.T @ ((y[k] - mu) / (1 + a[k] * mu))).max() < 1e-6


def test_special_functions():
    v = np.array([1e-3, 0.5, 1.0, 2.5, 9.9, 10.0, 123.4, 1e6])
    assert G.log_gamma(v) == pytest.approx([math.lgamma(z) for z in v], rel=1e-12, abs=1e-12)
    assert G.trigamma(1.0) == pytest.approx(math.pi**2 / 6) and G.trigamma(12.0) == pytest.approx(math.pi**2 / 6 - sum(1 / k**2 for k in range(1, 12)))


def frames(spark, x, s, y, drop_zeros=True):
    counts = [(f"g{g:03d}", i, int(v)) for g, row in enumerate(y) for i, v in enumerate(row) if v or not drop_zeros or not row.any()]
    samples = [(i, float(s[i]), *map(float, x[i, 1:])) for i in range(len(s))]
    return spark.createDataFrame(counts, "gene_id string, sample_id int, count long").repartition(3), spark.createDataFrame(samples, "sample_id int, size_factor double, case double, sex double, age double")


def test_the_whole_of_it(spark):
    x, s, b, y = study(300, 30, 8)
    y[5] = 0
    y[6, x[:, 1] == 1] = 0
    counts, samples = frames(spark, x, s, y)
    got = {r.gene_id: r for r in G.negative_binomial(counts, samples, ["case", "sex", "age"], "case").collect()}
    assert len(got) == 300 and got["g005"].p is None and got["g005"].base_mean == 0 and got["g005"].padj is None
    assert got["g006"].log2_fold_change < -5
    rest = [k for k in range(300) if k not in (5, 6)]
    miss = [(got[f"g{k:03d}"].log2_fold_change - b[k, 1] / math.log(2)) / got[f"g{k:03d}"].se for k in rest]
    assert abs(np.mean(miss)) < 0.2 and 0.85 < np.std(miss) < 1.2
    for k in rest[:40]:
        r = got[f"g{k:03d}"]
        assert r.p == pytest.approx(math.erfc(abs(r.log2_fold_change / r.se) / math.sqrt(2)), rel=1e-9) and r.padj >= r.p
        mu = s * np.exp(x @ np.array(r.coefficients))
        assert np.abs(x.T @ ((y[k] - mu) / (1 + r.dispersion * mu))).max() < 1e-5
    # shrunk dispersions lie closer together than each gene's own
    own = {r.gene_id: r.dispersion for r in G.negative_binomial(counts, samples, ["case", "sex", "age"], "case", shrink=False).collect()}
    spread = lambda d: np.std([math.log(d[f"g{k:03d}"]) for k in rest if own[f"g{k:03d}"] > 1e-5])
    assert spread({k: r.dispersion for k, r in got.items() if r.dispersion}) < spread(own)


def test_trend(spark):
    rng = np.random.default_rng(1)
    m = rng.uniform(5, 1000, 4000)
    rows = [(float(v), float((3.0 / v + 0.1) * rng.gamma(10, 0.1))) for v in m] + [(50.0, 90.0), (0.0, None), (9.0, 1e-8)]
    a1, a0 = G.dispersion_trend(spark.createDataFrame(rows, "base_mean double, own double"))
    assert a1 == pytest.approx(3.0, rel=0.1) and a0 == pytest.approx(0.1, rel=0.1)
    assert G.dispersion_trend(spark.createDataFrame([(1.0, 0.5)], "base_mean double, own double")) is None
    assert G.dispersion_trend(spark.createDataFrame([(1.0, 0.1), (10.0, 1.0), (100.0, 9.0)], "base_mean double, own double")) is None


def test_edges(spark):
    x, s, _, y = study(6, 10, 2)
    counts, samples = frames(spark, x, s, y)
    doubled = counts.unionByName(counts)
    twice = {r.gene_id: r.base_mean for r in G.negative_binomial(doubled, samples, ["case"], "case", dispersion=0.1).collect()}
    once = {r.gene_id: r.base_mean for r in G.negative_binomial(counts, samples, ["case"], "case", dispersion=0.1).collect()}
    assert all(twice[k] == pytest.approx(2 * once[k]) for k in once)
    less = samples.where("sample_id > 0").unionByName(spark.sql("select 77 sample_id, 1d size_factor, cast(null as double) `case`, 0d sex, 0d age"))
    assert G.negative_binomial(counts, less, ["case"], "case").count() == 6
    with pytest.raises(ValueError):
        G.negative_binomial(counts, samples.withColumn("sex", samples["case"] * 2), ["case", "sex"], "case")
    assert G.negative_binomial(counts.limit(0), samples, ["case"], "case").count() == 0


@pytest.mark.parametrize("adjusted", [False, True])
def test_dispersion_slopes(adjusted):
    x, s, b, y = study(20, 12, 4)
    mu = G.means(b, x, s)
    t = np.random.default_rng(2).uniform(-6, 2, 20)
    f = lambda v: G.likelihood(v, y, mu, x, adjusted)
    one, two = G.likelihood_slopes(t, y, mu, x, adjusted)
    assert one == pytest.approx((f(t + 1e-4) - f(t - 1e-4)) / 2e-4, rel=1e-5, abs=1e-5)
    assert two == pytest.approx((G.likelihood_slopes(t + 1e-4, y, mu, x, adjusted)[0] - G.likelihood_slopes(t - 1e-4, y, mu, x, adjusted)[0]) / 2e-4, rel=1e-5, abs=1e-5)


def test_dispersions_in_few_steps(monkeypatch):
    """The likelihood is evaluated on two grids a gene, not hundreds of times, and no dispersion of a fine grid is likelier."""
    x, s, _, y = study(200, 12, 7)
    y[:5] = np.maximum(np.round(s * 20), 1)  # no dispersion at all
    looked, plain = [], G.likelihood
    monkeypatch.setattr(G, "likelihood", lambda *a: looked.append(len(a[0])) or plain(*a))
    b, a = G.fit(y, s, x)
    assert sum(looked) < 100 * len(y)
    mu = G.means(b, x, s)
    best = np.max([plain(np.full(len(y), t), y, mu, x, True) for t in np.linspace(math.log(G.LOW), math.log(G.HIGH), 2000)], 0)
    assert (plain(np.log(a), y, mu, x, True) > best - 1e-4).all() and (a[:5] < 1e-4).all()
    prior = (np.log(np.full(len(y), 0.2)), 0.3)
    near, wide = G.dispersions(y, mu, x, True, prior, near=np.full(len(y), 1e-7)), G.dispersions(y, mu, x, True, prior)
    assert np.allclose(np.log(near), np.log(wide), atol=1e-6)


def test_polygammas():
    one, two = G.polygammas(np.array([1.0, 0.5, 12.0]))
    assert one[:2] == pytest.approx([-0.5772156649015329, -1.9635100260214235], rel=1e-12) and two[0] == pytest.approx(math.pi**2 / 6, rel=1e-12) and two[2] == pytest.approx(G.trigamma(12.0), rel=1e-12)
