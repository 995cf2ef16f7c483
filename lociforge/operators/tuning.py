"""Hyper-parameter search: a Gaussian process over a model's space proposes what to fit next.

Candidates are points of a unit cube, a side for each parameter (on a logarithmic scale where its space is). After some
random ones, a process with a Matern kernel is fitted to the scores, its length and noise by their likelihood; the point with the
largest expected improvement is next, and for a batch it is taken to score what the process expects, and the next is sought.

Folds are a column of the training rows, which are kept for all fits; the candidates of a batch are fitted at the same time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as C
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.cohort import folds
from lociforge.operators.models import fit, transformed

#: A parameter's space: its scale and its ends.
Space = dict[str, tuple[str, float, float]]

#: Spaces by model (fixed values). C is the inverse of the penalty of all rows: regParam is 1 / (C n).
SPACES: dict[str, Space] = {
    "elastic_net": {"C": ("log", 1e-4, 1e2), "l1_ratio": ("real", 0, 1), "max_iter": ("int", 100, 1000)},
    "naive_bayes": {"alpha": ("log", 1e-4, 1e2)},
    "linear_svc": {"C": ("log", 1e-4, 1e2)},
    "gradient_boosting": {"learning_rate": ("log", 1e-6, 1e-1), "max_iter": ("int", 50, 500), "max_depth": ("int", 3, 10)},
    "random_forest": {"max_iter": ("int", 50, 500), "max_depth": ("int", 3, 10)},
    "mlp": {"hidden_layer_sizes": ("int", 10, 100), "alpha": ("log", 1e-4, 1e-1)},
}


def estimator(name: str, values: dict[str, float], rows: int, width: int) -> Estimator:
    """A model of the stack with values of its space; what Spark's model has no parameter for (the penalty of mlp) is left out."""
    penalty = lambda: 1 / (values["C"] * max(rows, 1))
    made = {
        "elastic_net": lambda: C.LogisticRegression(elasticNetParam=values["l1_ratio"], regParam=penalty(), maxIter=int(values["max_iter"])),
        "naive_bayes": lambda: C.NaiveBayes(modelType="multinomial", smoothing=values["alpha"]),
        "linear_svc": lambda: C.LinearSVC(regParam=penalty()),
        "gradient_boosting": lambda: C.GBTClassifier(stepSize=values["learning_rate"], maxIter=int(values["max_iter"]), maxDepth=int(values["max_depth"]), seed=42),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=int(values["max_iter"]), maxDepth=int(values["max_depth"]), seed=42),
        "mlp": lambda: C.MultilayerPerceptronClassifier(layers=[width, int(values["hidden_layer_sizes"]), 2], seed=42, maxIter=50),
    }
    return made[name]()


def values_of(point: np.ndarray, space: Space) -> dict[str, float]:
    """A point of the unit cube as values of the space."""
    out = {}
    for u, (name, (scale, low, high)) in zip(point, space.items(), strict=True):
        v = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if scale == "log" else low + u * (high - low)
        out[name] = float(min(max(round(v) if scale == "int" else v, low), high))
    return out


def snapped(point: np.ndarray, space: Space) -> np.ndarray:
    """The point with whole numbers where the space has them, so that equal values are equal points."""
    out = point.copy()
    for k, (name, (scale, low, high)) in enumerate(space.items()):
        if scale == "int" and high > low:
            out[k] = (values_of(point, space)[name] - low) / (high - low)
    return out


class Process:
    """A Gaussian process over the unit cube, of standardised scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.scale = x, y.mean(), y.std() or 1.0
        self.y = (y - self.mean) / self.scale
        best = -np.inf
        for length in (0.1, 0.2, 0.35, 0.6, 1.0, 2.0):
            for noise in (1e-6, 1e-3, 1e-2, 1e-1):
                low = np.linalg.cholesky(self.kernel(x, x, length) + (noise + 1e-9) * np.eye(len(x)))
                a = np.linalg.solve(low, self.y)
                fit_ = -0.5 * a @ a - np.log(np.diag(low)).sum() - 0.5 * np.log(length) ** 2
                if fit_ > best:
                    best, self.length, self.low, self.a = fit_, length, low, a

    @staticmethod
    def kernel(x: np.ndarray, z: np.ndarray, length: float) -> np.ndarray:
        d = math.sqrt(5) * np.sqrt(((x[:, None] - z[None]) ** 2).sum(2)) / length
        return (1 + d + d * d / 3) * np.exp(-d)

    def at(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.linalg.solve(self.low, self.kernel(self.x, z, self.length))
        return self.mean + self.scale * (self.a @ k), self.scale * np.sqrt(np.maximum(1 - (k * k).sum(0), 1e-12))


def improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    """Expected gain over the best score."""
    z = (mean - best) / sd
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    return (mean - best) * below + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def propose(x: np.ndarray, y: np.ndarray, space: Space, n: int, rng: np.random.Generator, tried: int = 2000) -> np.ndarray:
    """The next n points to score, none of them scored before if there are others."""
    out = []
    for _ in range(n):
        process = Process(x, y)
        near = np.clip(x[np.argmax(y)] + rng.normal(0, 0.08, (tried // 4, x.shape[1])), 0, 1)
        z = np.unique([snapped(p, space) for p in np.concatenate([rng.random((tried, x.shape[1])), near])], axis=0)
        mean, sd = process.at(z)
        gain = improvement(mean, sd, y.max())
        gain[(np.abs(z[:, None] - x[None]).max(2) < 1e-12).any(1)] = -1
        k = int(gain.argmax())
        out.append(z[k])
        x, y = np.concatenate([x, z[k : k + 1]]), np.append(y, mean[k])
    return np.array(out)


def maximise(score: Callable[[list[dict[str, float]]], list[float]], space: Space, n: int, batch: int = 4, first: int | None = None, seed: int = 42) -> list[tuple[dict[str, float], float]]:
    """n candidates with their scores, in the order tried; `score` takes a batch of them. The first are random, one more than the space has sides if not given.

    A score that is not a number counts as the lowest one seen.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    first = min(n, first if first is not None else max(batch, len(space) + 1))
    x, y, out = np.zeros((0, len(space))), np.zeros(0), []
    while len(out) < n:
        left = n - len(out)
        if len(out) < first or np.isnan(y).all():
            points = np.array([snapped(p, space) for p in rng.random((min(batch, left, max(first - len(out), 1)), len(space)))])
        else:
            points = propose(x, np.where(np.isnan(y), np.nanmin(y), y), space, min(batch, left), rng)
        values = [values_of(p, space) for p in points]
        got = score(values)
        out += list(zip(values, got, strict=True))
        x, y = np.concatenate([x, points]), np.append(y, np.array(got, float))
    return out


def search(train: DataFrame, name: str, n: int = 10, n_folds: int = 10, batch: int = 4, seed: int = 42, space: Space | None = None, key: str = "sample_id") -> tuple[Model, DataFrame]:
    """The best of n candidates of a model of the stack by cross-validated area under the ROC curve, fitted on all rows, and what was tried.

    train: (key, label, features). Folds are dealt by a digest of the key; one whose rows have a single label does not
    count. Returns the model and (candidate, parameters, auc, folds), the highest auc first; a null auc is that of a candidate
    that could not be scored.
    """
    spark, space = train.sparkSession, space or SPACES[name]
    rows = folds(train.select(key, "label", "features"), n_folds, seed, key).persist()
    try:
        sizes = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()}
        total = sum(r.n for r in sizes.values())
        width = len(rows.select("features").first().features) if total else 0
        usable = sorted(k for k, r in sizes.items() if r.labels == 2)
        judge = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)

        def one(values: dict[str, float]) -> tuple[float, int]:
            found = []
            for k in usable:
                model = fit(rows.where(F.col("fold") != k), name, estimator(name, values, total - sizes[k].n, width))
                found.append(judge.evaluate(transformed(model, rows.where(F.col("fold") == k))))
            return (float(np.mean(found)) if found else math.nan), len(found)

        tried: list[int] = []
        with ThreadPoolExecutor(max_workers=batch) as pool:

            def score(many: list[dict[str, float]]) -> list[float]:
                got = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), v) for v in many]]
                tried.extend(n for _, n in got)
                return [auc for auc, _ in got]

            history = maximise(score, space, n, batch, seed=seed)
        if not history:
            raise ValueError("no candidates")
        best = max(history, key=lambda h: -math.inf if math.isnan(h[1]) else h[1])
        model = fit(train, name, estimator(name, best[0], total, width))
    finally:
        rows.unpersist()
    table = [(k, v, None if math.isnan(auc) else auc, f) for k, ((v, auc), f) in enumerate(zip(history, tried, strict=True))]
    return model, spark.createDataFrame(table, "candidate int, parameters map<string,double>, auc double, folds int").orderBy(F.desc_nulls_last("auc"), "candidate")
