"""Principal components of wide, sparse rows: a randomised subspace grows towards them by three passes over the rows.

A pass takes an orthonormal basis g of a few more columns than components, and gives c g for the scatter matrix c of the
centred rows, which itself is never built: each row adds its product with its own coordinates in the basis. Tasks keep
one sum of features x columns and send it in blocks of features, which are added over the cluster before the driver gets the
total. The driver holds the bases of all passes, each orthogonal to those before, and their images: the components are
looked for in what all of them span (a block Krylov space).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a block of sums; the most numbers of a basis (512 MB), beyond which there are too many features.
BLOCK, MOST = 4096, 1 << 26


def _rows(df: DataFrame, features: str) -> DataFrame:
    """at, v: the places (null: all of them) and values of each row's vector."""
    if dict(df.dtypes)[features] != "vector":
        return df.select(F.lit(None).cast("array<int>").alias("at"), F.col(features).cast("array<double>").alias("v")).where("v is not null")
    return df.where(F.col(features).isNotNull()).select(F.unwrap_udt(features).alias("u")).select(F.when(F.col("u.type") == 0, F.col("u.indices")).alias("at"), F.col("u.values").alias("v"))


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each number of a batch."""
    sizes = np.array([len(v) for v in batch.column("v")], np.int64)
    row, values = np.repeat(np.arange(batch.num_rows), sizes), batch.column("v").flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(sizes))[:-1], sizes)
    sparse = batch.column("at").is_valid().to_numpy(zero_copy_only=False)
    place[sparse[row]] = batch.column("at").flatten().to_numpy(zero_copy_only=False)
    return row, place, values


def _scatter(g: np.ndarray, shift: np.ndarray):
    """A partition's sums over rows x of x y', in blocks of features, with y = g'x - shift; block -1: the sum of y."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total = np.zeros(g.shape), np.zeros(g.shape[1])
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                row, place, v = _entries(batch)
                y = np.tile(-shift, (batch.num_rows, 1))
                for c in range(g.shape[1]):
                    y[:, c] += np.bincount(row, v * g[place, c], batch.num_rows)
                    z[:, c] += np.bincount(place, v * y[row, c], len(g))
                total += y.sum(0)
        if z.any() or total.any():
            for k in range(0, len(g), BLOCK):
                yield pa.record_batch([pa.array([k // BLOCK]), pa.array([z[k : k + BLOCK].tobytes()], pa.binary())], ["block", "z"])
            yield pa.record_batch([pa.array([-1]), pa.array([total.tobytes()], pa.binary())], ["block", "z"])

    return go


def _added(table: pa.Table) -> pa.Table:
    z = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("z")], 0)
    return pa.table([table.column("block").slice(0, 1), pa.array([z.tobytes()], pa.binary())], ["block", "z"])


def components(df: DataFrame, k: int = 10, features: str = "features", more: int = 20, turns: int = 2, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (a column each, its largest loading positive) and variances (of the sample, n - 1) of a vector column.

    Rows with a null vector are left out. There are fewer than k components if there are fewer features or rows.
    """
    rows = _rows(df, features)
    sizes = df.where(F.col(features).isNotNull()).select(features).first()
    if sizes is None:
        raise ValueError("no rows")
    d, n = len(sizes[0]), rows.count()
    width = max(1, min(k + more, d, n))
    if d * width * (turns + 1) > MOST:
        raise ValueError(f"{d} features by {turns + 1} times {width} columns are more than {MOST} numbers")
    place = F.when(F.col("at").isNull(), F.sequence(F.lit(0), F.lit(d - 1))).otherwise(F.col("at"))
    means = np.zeros(d)
    sums = rows.select(F.explode(F.arrays_zip(place.alias("at"), F.col("v").alias("v"))).alias("e")).groupBy(F.col("e.at").alias("at")).agg(F.sum("e.v").alias("s")).toArrow()
    means[sums.column("at").to_numpy()] = sums.column("s").to_numpy() / n
    g = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(d, width)))[0]
    basis, images = g[:, :0], g[:, :0]
    for _ in range(turns + 1):
        parts = rows.mapInArrow(_scatter(g, means @ g), "block bigint, z binary").groupBy("block").applyInArrow(_added, "block bigint, z binary")
        got = {r.block: np.frombuffer(r.z) for r in parts.toLocalIterator()}
        z = np.concatenate([got[b].reshape(-1, g.shape[1]) for b in range(-(-d // BLOCK))]) - np.outer(means, got[-1]) if got else np.zeros(g.shape)
        basis, images = np.concatenate([basis, g], 1), np.concatenate([images, z], 1)
        left = min(d, n) - basis.shape[1]
        if left <= 0:
            break
        for _ in range(2):  # what is new in the image, across from the basis
            z = np.linalg.qr(z - basis @ (basis.T @ z))[0]
        g = z[:, :left]
    t = basis.T @ images
    values, u = np.linalg.eigh((t + t.T) / 2)
    best = np.argsort(-values)[:k]
    # what the passes made of the components is nearer to the true ones than the basis that they were found in
    v = np.linalg.qr(images @ u[:, best])[0] if values[best].min(initial=0) > 1e-9 * max(values.max(initial=0), 1e-300) else basis @ u[:, best]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
    return means, v, np.maximum(values[best], 0) / max(n - 1, 1)


def principal_components(df: DataFrame, k: int = 10, features: str = "features", **params) -> DataFrame:
    """Adds pca, a vector: each row's coordinates along the first k components, of centred rows; null for a null vector."""
    means, v, _ = components(df, k, features, **params)
    shift = means @ v

    @F.pandas_udf("array<double>")
    def along(at: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else b @ (v if a is None else v[a]) - shift for a, b in zip(at, x, strict=True)])

    if dict(df.dtypes)[features] == "vector":
        u = F.unwrap_udt(features)
        at, x = F.when(u["type"] == 0, u["indices"]), u["values"]
    else:
        at, x = F.lit(None).cast("array<int>"), F.col(features).cast("array<double>")
    found = df.withColumn("pca", along(at, x))
    return found.withColumn("pca", F.when(F.col("pca").isNotNull(), array_to_vector("pca")))
