"""Mutual information of two columns from nearest neighbours in the plane (the estimator of Kraskov, Stoegbauer and Grassberger).

For each point, d is the distance (the larger of both coordinates') to its k-th nearest other point, and n_x, n_y are the points
nearer than d along each axis, itself among them: the information is digamma(n) + digamma(k) - mean(digamma(n_x) + digamma(n_y)).

Points are sorted along an axis and cut into blocks of equal size. A block finds its points' neighbours inside it; only where
such a circle reaches beyond the block are the blocks that it reaches asked, too, and the best of all answers count. With
about sqrt(n k) points a block is as wide as many neighbour distances, so most points need no other block. The counts along
an axis take the block where each end of the strip lies and the sizes of the blocks before it. All tasks get the blocks'
least and largest coordinates: two numbers a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.series import placed, with_totals
from lociforge.sources.shared import kept

#: The fewest and the most points of a block.
LEAST_BLOCK, MOST_BLOCK = 2_000, 2_000_000


def nearest(q: np.ndarray, p: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Distances of each point of q (x, y) to its k nearest of p, ascending, inf where p has fewer; own: the place in p of each point itself, which does not count.

    p is sorted by y. Points before and after a query's y are looked at, more and more, until none that is left can be nearer.
    """
    out = np.full((len(q), k), np.inf)
    if not len(p):
        return out
    at, left, width = np.searchsorted(p[:, 1], q[:, 1]), np.arange(len(q)), 4 * k + 4
    while len(left):
        rest, step = [], max(1, (1 << 22) // (2 * width))
        for some in np.split(left, range(step, len(left), step)):
            place = at[some, None] + np.arange(-width, width)
            there = (place >= 0) & (place < len(p))
            if own is not None:
                there &= place != own[some, None]
            near = p[np.clip(place, 0, len(p) - 1)]
            d = np.where(there, np.abs(near - q[some, None]).max(2), np.inf)
            d.sort(1)
            out[some, : min(k, d.shape[1])] = d[:, :k]
            low, high = at[some] - width - 1, at[some] + width
            beyond = np.minimum(np.where(low >= 0, q[some, 1] - p[np.maximum(low, 0), 1], np.inf), np.where(high < len(p), p[np.minimum(high, len(p) - 1), 1] - q[some, 1], np.inf))
            rest.append(some[out[some, k - 1] > beyond])
        left, width = np.concatenate(rest), width * 2
    return out


def _xy(t: pa.Table) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in ("x", "y")]) if t.num_rows else np.zeros((0, 2))


def _lists(d: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))


def _inside(k: int, low: np.ndarray, high: np.ndarray):
    """A block's points with their distances inside it, and the blocks that the circle may reach."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("y")
        p = _xy(t)
        d = nearest(p, p, k, np.arange(len(p)))
        block = t.column("block").to_numpy()
        reach = d[:, k - 1]
        # a block is reached if its nearest coordinate is not farther than the circle: bounds are in order
        first, last = np.searchsorted(high, p[:, 0] - reach, "left"), np.searchsorted(low, p[:, 0] + reach, "right") - 1
        # rounding of the ends must not leave a block out
        first, last = np.minimum(np.maximum(first - 1, 0), block), np.maximum(np.minimum(last + 1, len(low) - 1), block)
        return pa.table([t.column("id"), t.column("x"), t.column("y"), t.column("block"), pa.array(first), pa.array(last), _lists(d)], ["id", "x", "y", "block", "first", "last", "d"])

    return go


def _asked(k: int):
    def go(points: pa.Table, asks: pa.Table) -> pa.Table:
        return pa.table([asks.column("id"), _lists(nearest(_xy(asks), _xy(points.sort_by("y")), k))], ["id", "d"])

    return go


def _upto(points: pa.Table, asks: pa.Table) -> pa.Table:
    """How many of a block's coordinates lie before each asked end (upper: v - x <= r; else x - v > r)."""
    v = np.sort(points.column("v").to_numpy())
    x, r, upper = (asks.column(c).to_numpy(zero_copy_only=False) for c in ("x", "r", "upper"))
    n = np.searchsorted(v, np.where(upper, x + r, x - r), "right")

    def holds(at: np.ndarray) -> np.ndarray:
        w = v[np.clip(at, 0, max(len(v) - 1, 0))] if len(v) else np.zeros(len(at))
        return np.where(upper, w - x <= r, x - w > r)

    while (move := (n < len(v)) & holds(n)).any():  # sums are rounded, differences decide
        n[move] += 1
    while (move := (n > 0) & ~holds(n - 1)).any():
        n[move] -= 1
    return pa.table([asks.column("id"), pa.array(np.where(upper, n, -n))], ["id", "n"])


def _nearer(batches):
    """The largest radius below each distance."""
    for b in batches:
        yield pa.record_batch([*(b.column(c) for c in ("id", "x", "y")), pa.array(np.nextafter(b.column("d").to_numpy(), 0.0))], ["id", "x", "y", "r"])


def _blocks(df: DataFrame, axis: str, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Points with the block of their place along an axis, and the blocks' least and largest coordinates and sizes."""
    rows = kept(placed(df, "_r", [F.col(axis), F.col("id")]).withColumn("block", F.expr(f"(_r - 1) div {size}")).drop("_r"))
    bounds = rows.groupBy("block").agg(F.min(axis).alias("a"), F.max(axis).alias("b"), F.count("*").alias("n")).orderBy("block").toPandas()
    return rows, bounds["a"].to_numpy(float), bounds["b"].to_numpy(float), bounds["n"].to_numpy(np.int64)


def _strip(rows: DataFrame, axis: str, low: np.ndarray, sizes: np.ndarray, radii: DataFrame) -> DataFrame:
    """(id, n): coordinates within the radius of each point's, itself among them. radii: id, x, y, r."""
    before = np.append(0, np.cumsum(sizes))

    def place(batches):
        for b in batches:
            x, r = b.column("x").to_numpy(), b.column("r").to_numpy()
            for upper in (True, False):
                at = np.searchsorted(low, x + r if upper else x - r, "right") - 1
                hold = lambda k: np.where((k >= 0) & (k < len(low)), low[np.clip(k, 0, len(low) - 1)] - x <= r if upper else x - low[np.clip(k, 0, len(low) - 1)] > r, k < 0)  # noqa: B023, E731
                while (move := (at + 1 < len(low)) & hold(at + 1)).any():
                    at[move] += 1
                while (move := (at >= 0) & ~hold(at)).any():
                    at[move] -= 1
                at = np.maximum(at, 0)
                yield pa.record_batch([b.column("id"), b.column("x"), b.column("r"), pa.array(np.full(len(x), upper)), pa.array(at.astype(np.int64)), pa.array(before[at] if upper else -before[at])], ["id", "x", "r", "upper", "block", "n"])

    kind = dict(radii.dtypes)["id"]
    asks = radii.select("id", F.col(axis).alias("x"), "r").mapInArrow(place, f"id {kind}, x double, r double, upper boolean, block bigint, n bigint")
    inner = rows.select("block", F.col(axis).alias("v")).groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_upto, f"id {kind}, n bigint")
    return asks.select("id", "n").unionByName(inner).groupBy("id").agg(F.sum("n").alias("n"))


#: digamma at 1 to 9.
_DIGAMMA = [-0.5772156649015329 + sum(1 / j for j in range(1, m)) for m in range(1, 10)]


def _digamma(n: Column) -> Column:
    z = 1 / (n * n)
    series = F.ln(n) - 1 / (2 * n) - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return F.when(n < 10, F.get(F.array(*map(F.lit, _DIGAMMA)), n.cast("int") - 1)).otherwise(series)


def mutual_information(df: DataFrame, a: str, b: str, k: int = 3, key: str = "id", block: int | None = None) -> DataFrame:
    """One row, mi: the information of two columns in nats, 0 at least; null if there are no more than k rows with both.

    Columns are divided by their population deviations first (a constant one is left as it is). Rows that lack one are left
    out; key tells rows apart. Points whose k-th neighbour has the same place count those with equal coordinates.
    """
    rows = df.select(F.col(key).alias("id"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    t = with_totals(rows, _sx=F.stddev_pop("x"), _sy=F.stddev_pop("y"), _n=F.count("*"))
    scaled = kept(t.select("id", *[(F.col(c) / F.coalesce(F.nullif(F.col(f"_s{c}"), F.lit(0.0)), F.lit(1.0))).alias(c) for c in ("x", "y")]))
    n = scaled.count()
    if n <= k:
        return df.sparkSession.createDataFrame([(None,)], "mi double")
    size = block or min(max(int(math.sqrt(n * k)) + 1, LEAST_BLOCK), MOST_BLOCK)
    by_x, low, high, sizes = _blocks(scaled, "x", size)
    kind = dict(scaled.dtypes)["id"]
    inside = kept(by_x.groupBy("block").applyInArrow(_inside(k, low, high), f"id {kind}, x double, y double, block bigint, first bigint, last bigint, d array<double>"))
    asks = inside.select("id", "x", "y", F.col("block").alias("home"), F.explode(F.sequence("first", "last")).alias("block")).where("block <> home")
    answers = by_x.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_asked(k), f"id {kind}, d array<double>")
    best = inside.select("id", "d").unionByName(answers).groupBy("id").agg(F.get(F.sort_array(F.flatten(F.collect_list("d"))), F.lit(k - 1)).alias("d"))
    radii = kept(scaled.join(best, "id").mapInArrow(_nearer, f"id {kind}, x double, y double, r double"))
    by_y, low_y, _, sizes_y = _blocks(scaled, "y", size)
    both = _strip(by_x, "x", low, sizes, radii).withColumnRenamed("n", "nx").join(_strip(by_y, "y", low_y, sizes_y, radii).withColumnRenamed("n", "ny"), "id")
    told = both.agg(F.avg(_digamma(F.col("nx")) + _digamma(F.col("ny"))).alias("m"), F.count("*").alias("n"))
    return told.select(F.greatest(F.lit(0.0), _digamma(F.col("n")) + _digamma(F.lit(k)) - F.col("m")).alias("mi"))
