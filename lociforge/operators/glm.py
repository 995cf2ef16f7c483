"""Negative binomial regression of counts, one for each gene, on any design of the samples.

A gene's counts y of samples with size factors s have the mean s exp(x b) and the variance mean + a mean^2. Steps:

1. Each gene's coefficients b and dispersion a by maximum likelihood, in turns: b by iteratively reweighted least squares,
   a by a search on its logarithm, with the adjustment of Cox and Reid for the coefficients (unless it is turned off).
2. The trend a = a1 / base mean + a0 over all genes: a gamma regression, whose steps are aggregates over the cluster.
3. Dispersions are shrunk towards the trend by a normal prior of their logarithms, whose width is what the genes' spread
   leaves beyond sampling; genes far above the trend keep their own.
4. Coefficients, standard errors and Wald tests at the final dispersions, adjusted p values.

Genes travel as packed rows and are fitted side by side in numpy, a bounded number of counts at a time. The design has a row
for each sample and goes to all tasks; its size is checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.series import bh_adjust
from lociforge.operators.quantiles import quantiles
from lociforge.sources.shared import kept

#: Counts that are fitted side by side; most samples of a study; range of dispersions.
CELLS, MOST_SAMPLES, LOW, HIGH = 1 << 20, 1_000_000, 1e-8, 100.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series beyond 10; smaller values are lifted by 10."""
    x, low = np.array(x, float), None
    small = x < 10
    if small.any():
        low = x[small]
        x[small] += 10
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360 - z / 156)))))) / x
    out = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    if low is not None:
        out[small] -= np.log(math.prod(low + k for k in range(10)))
    return out


def polygammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two derivatives of log_gamma, by the same series."""
    x, low = np.array(x, float), None
    small = x < 10
    if small.any():
        low = x[small]
        x[small] += 10
    z = 1 / (x * x)
    one = np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132 - z * (691 / 32760 - z / 12))))))
    two = 1 / x + z / 2 + (z / x) * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * (5 / 66 - z * (691 / 2730 - z * 7 / 6))))))
    if low is not None:
        for k in range(10):
            u = 1 / (low + k)
            one[small] -= u
            two[small] += u * u
    return one, two


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    z = 1 / (x * x)
    return total + 1 / x + z / 2 + (z / x) * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def means(b: np.ndarray, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.maximum(s * np.exp(np.clip(b @ x.T, -30, 30)), 1e-9)


def squares(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of weighted products of the design's columns: a matrix for each row of w."""
    n, p = x.shape
    if n * p * p > CELLS:
        return np.einsum("gi,ij,ik->gjk", w, x, x)
    return (w @ (x[:, :, None] * x[:, None, :]).reshape(n, p * p)).reshape(-1, p, p)


def coefficients(y: np.ndarray, s: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood coefficients of genes (rows of y) at dispersions a; a coefficient that has no maximum ends near 30 or -30."""
    p = x.shape[1]
    b = np.linalg.lstsq(x, np.log(y / s + 0.1).T, rcond=None)[0].T if b is None else b.copy()
    left = np.arange(len(y))
    for _ in range(steps):
        mu = means(b[left], x, s)
        w = mu / (1 + a[left, None] * mu)
        info = squares(w, x) + 1e-9 * np.eye(p)
        step = np.linalg.solve(info, ((y[left] - mu) * w / mu @ x)[..., None])[..., 0]
        step *= np.minimum(1, 4 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
        b[left] = np.clip(b[left] + step, -30, 30)
        left = left[np.abs(step).max(1) > 1e-11]
        if not len(left):
            break
    return b


def errors(x: np.ndarray, mu: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Standard errors of the coefficients."""
    info = squares(mu / (1 + a[:, None] * mu), x) + 1e-9 * np.eye(x.shape[1])
    return np.sqrt(np.einsum("gjj->gj", np.linalg.inv(info)))


def likelihood(log_a: np.ndarray, y: np.ndarray, mu: np.ndarray, x: np.ndarray, adjusted: bool) -> np.ndarray:
    """Log likelihood of each gene's dispersion at given means, without what does not depend on it."""
    a = np.exp(log_a)[:, None]
    r = 1 / a
    out = (log_gamma(y + r) + y * np.log(a * mu) - (y + r) * np.log1p(a * mu)).sum(1) - y.shape[1] * log_gamma(r[:, 0])
    if adjusted:
        out -= 0.5 * np.linalg.slogdet(squares(mu / (1 + a * mu), x) + 1e-12 * np.eye(x.shape[1]))[1]
    return out


def likelihood_slopes(log_a: np.ndarray, y: np.ndarray, mu: np.ndarray, x: np.ndarray, adjusted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first two derivatives of likelihood by log_a."""
    r = np.exp(-log_a)[:, None]
    (p1, p2), (q1, q2), s = polygammas(y + r), polygammas(r), r + mu
    off = (mu - y) / s
    one = (p1 - q1 - np.log1p(mu / r) + off).sum(1)
    two = (p2 - q2 + (mu / r - off) / s).sum(1)
    if adjusted:
        info = squares(mu * r / s, x) + 1e-12 * np.eye(x.shape[1])
        v = (mu / s) ** 2
        turn, bend = np.linalg.solve(info, squares(v, x)), np.linalg.solve(info, squares(-2 * v / s, x))
        one -= 0.5 * np.einsum("gjj->g", turn)
        two -= 0.5 * (np.einsum("gjj->g", bend) - np.einsum("gjk,gkj->g", turn, turn))
    r = r[:, 0]
    return -r * one, r * r * two + r * one


def dispersions(y: np.ndarray, mu: np.ndarray, x: np.ndarray, adjusted: bool, prior: tuple[np.ndarray, float] | None = None, grid: int = 25, near: np.ndarray | None = None) -> np.ndarray:
    """The dispersion of each gene that is likeliest at given means; prior: a normal one of its logarithm, by centre and variance.

    The best of a grid lies between its neighbours, where Newton's method (halving where a step would leave what is left of
    the range) takes the slope to 0. With `near`, dispersions close to it, the grid is left to genes that have no maximum within
    a step of it there.
    """
    ends = np.linspace(math.log(LOW), math.log(HIGH), grid)
    if near is None:
        values = []
        for t in ends:
            f = likelihood(np.full(len(y), t), y, mu, x, adjusted)
            values.append(f if prior is None else f - (t - prior[0]) ** 2 / (2 * prior[1]))
        best = np.argmax(values, 0)
        t, low, high = ends[best], ends[np.maximum(best - 1, 0)], ends[np.minimum(best + 1, grid - 1)]
    else:
        t = np.log(near)
        low, high = np.maximum(t - (ends[1] - ends[0]), ends[0]), np.minimum(t + (ends[1] - ends[0]), ends[-1])
    edges, left = (low.copy(), high.copy()), np.arange(len(y))
    for _ in range(100):
        one, two = likelihood_slopes(t[left], y[left], mu[left], x, adjusted)
        if prior is not None:
            one, two = one - (t[left] - prior[0][left]) / prior[1], two - 1 / prior[1]
        up = one > 0
        low[left], high[left] = np.where(up, t[left], low[left]), np.where(up, high[left], t[left])
        new = t[left] - one / np.where(two < 0, two, -np.inf)
        new = np.where((two < 0) & (new >= low[left]) & (new <= high[left]), new, (low[left] + high[left]) / 2)
        moved = np.abs(new - t[left]) > 1e-11
        t[left] = new
        left = left[moved]
        if not len(left):
            break
    out = np.exp(t)
    if near is not None:
        lost = np.flatnonzero(((t < edges[0] + 1e-9) & (edges[0] > ends[0])) | ((t > edges[1] - 1e-9) & (edges[1] < ends[-1])))
        if len(lost):
            out[lost] = dispersions(y[lost], mu[lost], x, adjusted, None if prior is None else (prior[0][lost], prior[1]), grid)
    return out


def fit(y: np.ndarray, s: np.ndarray, x: np.ndarray, adjusted: bool = True, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and dispersions of genes, fitted in turns until dispersions stand still.

    The first turn seeks the dispersion in its whole range, and so does the last; those between seek it near that of the turn before.
    """
    q = y / s
    m = q.mean(1)
    a = np.clip((q.var(1, ddof=1) - (1 / s).mean() * m) / np.maximum(m, 1e-9) ** 2, 1e-4, 10)
    b, left, whole = coefficients(y, s, x, a), np.arange(len(y)), np.full(len(y), True)
    for _ in range(rounds):
        mu, new = means(b[left], x, s), np.empty(len(left))
        for near in (False, True):
            these = np.flatnonzero(whole[left] != near)
            if len(these):
                new[these] = dispersions(y[left[these]], mu[these], x, adjusted, near=a[left[these]] if near else None)
        b[left] = coefficients(y[left], s, x, new, b[left])
        moved = np.abs(np.log(new / a[left])) > 1e-9
        a[left] = new
        done = ~moved & whole[left]
        whole[left] = ~moved  # what stands still near its place is sought once more in the whole range
        left = left[~done]
        if not len(left):
            break
    return b, a


def _dense(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of genes with their counts as a matrix of n samples; absent ones are 0."""
    each = max(1, CELLS // n)
    for whole in batches:
        for k in range(0, whole.num_rows, each):
            batch = whole.slice(k, each)
            y, of = np.zeros((batch.num_rows, n)), np.append(0, np.cumsum(batch.column("at").value_lengths().to_numpy()))
            at, c = (batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("at", "counts"))
            np.add.at(y, (np.repeat(np.arange(batch.num_rows), np.diff(of)), at), c)
            yield batch, y


def _own(s: np.ndarray, x: np.ndarray, adjusted: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, y in _dense(batches, len(s)):
            a, some = np.full(len(y), np.nan), y.any(1)
            if some.any():
                a[some] = fit(y[some], s, x, adjusted)[1]
            yield pa.record_batch([*batch.columns, pa.array((y / s).mean(1)), pa.array(a, from_pandas=True)], [*batch.schema.names, "base_mean", "own"])

    return go


def _final(s: np.ndarray, x: np.ndarray, test: int, adjusted: bool, width: float | None, given: float | None, keep: int):
    """Shrinks (if there is a trend), fits, and tells the tested coefficient and all of them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["base_mean", "dispersion", "log2_fold_change", "se", "p", "coefficients"]
        for batch, y in _dense(batches, len(s)):
            some = np.flatnonzero(y.any(1))
            out = np.full((5, len(y)), np.nan)
            out[0] = (y / s).mean(1)
            found = [None] * len(y)
            if len(some):
                y = y[some]
                if given is not None:
                    a = np.full(len(some), given)
                else:
                    own, trend = (batch.column(c).to_numpy(zero_copy_only=False)[some].astype(float) for c in ("own", "trend"))
                    first = coefficients(y, s, x, own)
                    shrunk = dispersions(y, means(first, x, s), x, adjusted, (np.log(trend), width)) if width else own
                    a = np.where(np.log(own) > np.log(trend) + 2 * math.sqrt(width + trigamma((len(s) - x.shape[1]) / 2)), own, shrunk) if width else own
                b = coefficients(y, s, x, a)
                se = errors(x, means(b, x, s), a)[:, test]
                p = [math.erfc(abs(v / e) / math.sqrt(2)) for v, e in zip(b[:, test], se, strict=True)]
                out[1:, some] = [a, b[:, test] / math.log(2), se / math.log(2), p]
                for k, v in zip(some, b, strict=True):
                    found[k] = v.tolist()
            yield pa.record_batch([*batch.columns[:keep], *(pa.array(v, from_pandas=True) for v in out), pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names[:keep], *names])

    return go


def dispersion_trend(genes: DataFrame, rounds: int = 20) -> tuple[float, float] | None:
    """(a1, a0) of the trend own = a1 / base_mean + a0: a gamma regression by reweighted least squares, each step one aggregate.

    Genes whose dispersion is at its lower end, or 15 times above or 10,000 times below the trend of the step before, do not
    count. None if no such trend fits (a coefficient is not positive).
    """
    known = genes.where((F.col("own") > 100 * LOW) & (F.col("base_mean") > 0)).select((1 / F.col("base_mean")).alias("u"), "own")
    a1, a0, before = None, None, None
    for _ in range(rounds):
        if before is None:
            rows, v = known, F.lit(1.0)
        else:
            v = F.lit(a1) * F.col("u") + F.lit(a0)
            rows = known.where((F.col("own") / v).between(1e-4, 15))
        w = 1 / (v * v)
        s = rows.agg(*[F.sum(e).alias(k) for k, e in {"w": w, "u": w * F.col("u"), "uu": w * F.col("u") * F.col("u"), "y": w * F.col("own"), "uy": w * F.col("u") * F.col("own")}.items()]).first()
        det = (s.w or 0.0) * (s.uu or 0.0) - (s.u or 0.0) ** 2
        if not det > 1e-12 * (s.w or 0.0) * (s.uu or 1.0):
            return None
        a1, a0 = (s.w * s.uy - s.u * s.y) / det, (s.uu * s.y - s.u * s.uy) / det
        if a1 <= 0 or a0 <= 0:
            return None
        if before and abs(math.log(a1 / before[0])) + abs(math.log(a0 / before[1])) < 1e-9:
            break
        before = (a1, a0)
    return a1, a0


def _median(df: DataFrame) -> float:
    """The median of d, 0 without rows."""
    r = quantiles(df, "d", [0.5]).first()
    return r.quantiles[0] if r else 0.0


def negative_binomial(counts: DataFrame, samples: DataFrame, columns: list[str], test: str, dispersion: float | None = None, adjusted: bool = True, shrink: bool = True, gene: str = "gene_id", sample: str = "sample_id", count: str = "count", factor: str = "size_factor") -> DataFrame:
    """gene, base_mean, dispersion, log2_fold_change, se, p, coefficients, padj of `test`, one of the design's columns.

    counts: (gene, sample, count), an absent one being 0, repeated ones summed; samples: (sample, size factor, numeric design
    columns), one row each; the intercept is added. A sample without a row there, or with a null in it, is left out. With
    `dispersion` all genes have that one. Genes without counts have null results but base_mean 0. coefficients are natural
    logarithms, the intercept first. At most MOST_SAMPLES samples; a design whose columns depend on each other, or with as many
    columns as samples, is an error.
    """
    spark = counts.sparkSession
    known = samples.select(F.col(sample).alias("_s"), F.col(factor).cast("double").alias("_f"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)]).dropna().orderBy("_s").limit(MOST_SAMPLES + 1)
    rows = known.toPandas()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    x = np.column_stack([np.ones(len(rows)), rows.iloc[:, 2:].to_numpy(float)])
    s = rows["_f"].to_numpy(float)
    if len(x) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design has too few samples, or columns that depend on each other")
    places = spark.createDataFrame([(v, k) for k, v in enumerate(rows["_s"].tolist())], f"_s {dict(counts.dtypes)[sample]}, at int")
    cells = counts.where(F.col(count).isNotNull()).select(gene, F.col(sample).alias("_s"), F.col(count).cast("double").alias("n")).join(F.broadcast(places), "_s", "left")
    # fits take longer than what they read is large, so the genes are dealt to all partitions
    packed = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), gene).groupBy(gene).agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n"))).alias("v")).select(gene, F.col("v.at").alias("at"), F.col("v.n").alias("counts"))
    kind, at, result = dict(counts.dtypes)[gene], 1 + columns.index(test), "base_mean double, dispersion double, log2_fold_change double, se double, p double, coefficients array<double>"
    if dispersion is not None:
        fitted = packed.mapInArrow(_final(s, x, at, adjusted, None, dispersion, 1), f"`{gene}` {kind}, {result}")
        return bh_adjust(kept(fitted))
    own = kept(packed.mapInArrow(_own(s, x, adjusted), f"`{gene}` {kind}, at array<int>, counts array<double>, base_mean double, own double"))
    line = dispersion_trend(own) if shrink else None
    trend, width = F.col("own"), None
    if shrink:
        middle = own.where(F.col("own") > 100 * LOW).agg(F.exp(F.avg(F.ln("own"))).alias("m")).first().m
        trend = F.lit(line[0]) / F.col("base_mean") + F.lit(line[1]) if line else F.lit(middle if middle else LOW)
        off = own.where((F.col("own") > 100 * LOW) & (F.col("base_mean") > 0)).select((F.ln("own") - F.ln(trend)).alias("d"))
        centre = _median(off)
        spread = _median(off.select(F.abs(F.col("d") - centre).alias("d")))
        width = max((1.4826 * spread) ** 2 - trigamma((len(x) - x.shape[1]) / 2), 0.25)
    told = own.select(gene, "at", "counts", "own", F.when(F.col("base_mean") > 0, trend).alias("trend"))
    return bh_adjust(kept(told.mapInArrow(_final(s, x, at, adjusted, width, None, 1), f"`{gene}` {kind}, {result}")))
