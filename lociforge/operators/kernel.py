"""A kernel classifier with probabilities: a support vector machine on Nystroem features of an RBF kernel, calibrated by a sigmoid.

Landmarks are a bounded number of rows, chosen by the smallest digests of their keys. A row's features are its kernel with
the landmarks, whitened by the landmarks' own kernel: inner products of features approximate the kernel, and equal it on the
landmarks. The machine is fitted by Newton's method, a pass over the rows for each step, whose sums have the size of the
landmarks squared. The sigmoid that turns scores into probabilities is fitted on scores of rows that the scoring machine
has not seen: folds are left out in turn, by machines that share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.cohort import draw_order, folds


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ z.T + (z * z).sum(1)
    return np.exp(-gamma * np.maximum(d, 0))


@dataclass
class Nystroem:
    """Landmarks, scaled to [0, 1] by the ranges of the training rows, and what whitens their kernel."""

    low: np.ndarray
    width: np.ndarray
    landmarks: np.ndarray
    whiten: np.ndarray
    gamma: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / self.width

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(self.scaled(x), self.landmarks, self.gamma) @ self.whiten


def nystroem(train: DataFrame, gamma: float | None = None, landmarks: int = 200, seed: int = 42, key: str = "sample_id", features: str = "features") -> Nystroem:
    """The feature map of training rows; gamma is 1 over features times the variance of scaled values if not given. At most `landmarks` rows are collected."""
    from pyspark.ml.stat import Summarizer

    known = train.where(F.col(features).isNotNull())
    s = known.select(Summarizer.metrics("min", "max").summary(F.col(features)).alias("s")).select("s.*").first()
    low, high = s["min"].toArray(), s["max"].toArray()
    width = np.where(high > low, high - low, 1.0)
    rows = known.select(features, draw_order(F.col(key), seed).alias("_d"), key).orderBy("_d", key).limit(landmarks).collect()
    z = np.unique((np.array([r[0].toArray() for r in rows]) - low) / width, axis=0)
    gamma = gamma or 1 / max(z.shape[1] * z.var(), 1e-12)
    values, u = np.linalg.eigh(kernel(z, z, gamma))
    good = values > 1e-10 * values[-1]
    return Nystroem(low, width, z, u[:, good] / np.sqrt(values[good]), gamma)


@dataclass
class KernelModel:
    """A fitted classifier: its feature map, its plane, and the sigmoid of its scores."""

    map: Nystroem
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds score, the distance from the plane, and y_pred, the probability of class 1; null for a null vector."""
        m, w, b = self.map, self.map.whiten @ self.weights, self.bias

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(kernel(m.scaled(np.stack(x.to_numpy())), m.landmarks, m.gamma) @ w + b if len(x) else [])

        known, none = df.where(F.col(features).isNotNull()), F.lit(None).cast("double")
        out = known.withColumn("score", scored(vector_to_array(features))).withColumn("y_pred", 1 / (1 + F.exp(-(self.slope * F.col("score") + self.offset))))
        return out.unionByName(df.where(F.col(features).isNull()).withColumns({"score": none, "y_pred": none}))


def _pass(m: Nystroem, planes: np.ndarray, biases: np.ndarray, left_out: np.ndarray):
    """A partition's sums for Newton steps of several planes, each without the rows of its fold: rows inside the margin as products."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = planes.shape[1] + 1
        h, g, held = np.zeros((len(planes), d, d)), np.zeros((len(planes), d)), []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = m.features(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
            x, t, fold = np.column_stack([x, np.ones(len(x))]), 2.0 * batch.column("label").to_numpy() - 1, batch.column("fold").to_numpy()
            for k, (w, b, out) in enumerate(zip(planes, biases, left_out, strict=True)):
                near = (fold != out) & (t * (x[:, :-1] @ w + b) < 1)
                h[k] += x[near].T @ x[near]
                g[k] += x[near].T @ t[near]
        yield pa.record_batch([pa.array([np.concatenate([h.ravel(), g.ravel()]).tobytes()], pa.binary())], ["sums"])

    return go


def planes(rows: DataFrame, m: Nystroem, left_out: list[int], penalty: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of squared-hinge machines, one for each fold left out (-1: none), by Newton's method: all share a pass over the rows each step."""
    d, out = m.whiten.shape[1], np.array(left_out)
    w, b = np.zeros((len(out), d)), np.zeros(len(out))
    for _ in range(rounds):
        parts = rows.mapInArrow(_pass(m, w, b, out), "sums binary").collect()
        sums = np.sum([np.frombuffer(r.sums) for r in parts], 0)
        h, g = sums[: len(out) * (d + 1) ** 2].reshape(-1, d + 1, d + 1), sums[len(out) * (d + 1) ** 2 :].reshape(-1, d + 1)
        ridge = np.diag(np.append(np.ones(d), 1e-9)) / (2 * penalty)
        new = np.stack([np.linalg.solve(x + ridge, y) for x, y in zip(h, g, strict=True)])
        moved = np.abs(new[:, :-1] - w).max() + np.abs(new[:, -1] - b).max()
        w, b = new[:, :-1], new[:, -1]
        if moved < 1e-8:
            break
    return w, b


def sigmoid(scores: np.ndarray, label: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve that is likeliest for counted scores."""
    v, p = np.column_stack([scores, np.ones(len(scores))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(v @ p, -30, 30)))
        step = np.linalg.solve((v * (counts * q * (1 - q))[:, None]).T @ v + 1e-9 * np.eye(2), v.T @ (counts * (label - q)))
        p = p + step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-10:
            break
    return float(p[0]), float(p[1])


def fit_kernel(train: DataFrame, penalty: float = 1.0, gamma: float | None = None, landmarks: int = 200, n_folds: int = 5, seed: int = 42, key: str = "sample_id", places: int = 2) -> KernelModel:
    """Fits on (key, label, features). penalty is C: the weight of all rows' squared errors against that of the margin.

    Rows with a null label or vector are left out; a fold whose rest has a single label is not scored. The sigmoid is fitted
    on scores rounded to so many places and counted; without any scored fold it stays that of the scores themselves.
    """
    known = train.where("label is not null and features is not null")
    m = nystroem(known, gamma, landmarks, seed, key)
    rows = folds(known, n_folds, seed, key).select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), "fold").persist()
    try:
        sizes = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("cases")).collect()}
        n, cases = sum(r.n for r in sizes.values()), sum(r.cases for r in sizes.values())
        used = [k for k, r in sorted(sizes.items()) if 0 < cases - r.cases < n - r.n]
        w, b = planes(rows, m, [-1, *used], penalty)
        slope, offset, scored = 1.0, 0.0, None
        for k, v, c in zip(used, w[1:], b[1:], strict=True):
            one = KernelModel(m, v, float(c), 1.0, 0.0).predict(rows.where(F.col("fold") == k).select("label", array_to_vector("x").alias("features")))
            scored = one if scored is None else scored.unionByName(one)
        if scored is not None:
            counted = scored.groupBy(F.round("score", places).alias("s"), "label").agg(F.count("*").alias("c")).toPandas()
            slope, offset = sigmoid(counted["s"].to_numpy(float), counted["label"].to_numpy(float), counted["c"].to_numpy(float))
        return KernelModel(m, w[0], float(b[0]), slope, offset)
    finally:
        rows.unpersist()
