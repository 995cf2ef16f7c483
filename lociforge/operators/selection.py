"""Feature selection from posterior samples: effect sizes, tail threshold of their density, choice."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.functions.series import gradient, placed, reverse_cumsum, smooth, with_totals


#: The least deviation of a point's density, as a share of the range.
LEAST_WIDTH = 1e-6


def effect_sizes(draws: DataFrame, feature: str = "feature_name", beta: str = "beta") -> DataFrame:
    """Mean, population deviation (a zero replaced by the smallest step of doubles) and |mean / deviation| of each feature."""
    s = draws.groupBy(feature).agg(F.avg(beta).alias("beta_mean"), F.stddev_pop(beta).alias("beta_std"))
    s = s.withColumn("beta_std", F.when(F.col("beta_std") == 0, 2.220446049250313e-16).otherwise(F.col("beta_std")))
    return s.withColumn("effect_size", F.abs(F.col("beta_mean") / F.col("beta_std")))


def adaptive_kde(points: DataFrame, value: str = "x", neighbours: int = 10, grid: int = 1000, least: float = LEAST_WIDTH) -> DataFrame:
    """Density (k, x, density) on an even grid: mean of normal densities whose deviation is the distance to a point's 10th neighbour, itself the first.

    The neighbours of a point in one dimension are among the nine before and after it in order, which meet it in a join on
    their places in a sorted table; the grid, which is small, is broadcast. Of fewer points the farthest counts. No deviation is
    below `least` of the range of all points (of 1, where they are all equal), so that ties leave the density defined. With 0 a
    point that nine others equal has the deviation 0, and no density at all is a number.
    """
    places = placed(points.select(F.col(value).cast("double").alias("_v")).where("_v is not null"), "_r", [F.col("_v")])
    offsets = F.explode(F.array(*[F.lit(k) for k in range(1 - neighbours, neighbours) if k]))
    far = places.select("_r", "_v", offsets.alias("_k")).select((F.col("_r") + F.col("_k")).alias("_r"), F.col("_v").alias("_w"))
    around = places.join(far, "_r", "left").groupBy("_r", "_v").agg(F.sort_array(F.collect_list(F.abs(F.col("_w") - F.col("_v")))).alias("_d"))
    p = around.select("_v", F.coalesce(F.get("_d", F.lit(neighbours - 2)), F.array_max("_d"), F.lit(0.0)).alias("_d"))
    t = with_totals(p, _low=F.min("_v"), _high=F.max("_v"), _n=F.count("*"))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    t = t.withColumn("_h", F.greatest("_d", least * span))
    grid_points = t.select("_low", "_high").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"), "_low", "_high").select("k", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("k") / (grid - 1)).alias("x"))
    z = (F.col("x") - F.col("_v")) / F.nullif(F.col("_h"), F.lit(0.0))
    pdf = F.when(F.col("_h") > 0, F.exp(-0.5 * z * z) / (F.col("_h") * math.sqrt(2 * math.pi))).otherwise(math.nan)
    return t.crossJoin(F.broadcast(grid_points)).groupBy("k", "x").agg((F.sum(pdf) / F.first("_n")).alias("density"))


def tail_threshold(density: DataFrame, tail: float = 0.1, sensitivity: float = 0.005, window: int = 5) -> DataFrame:
    """One row (k, threshold): where, in the tail that holds at most `tail` of the density, `window` gradients in a row are negative and
    their mean is below -sensitivity; without such a place, where the tail begins.
    """
    step = with_totals(density, _dx=(F.max("x") - F.min("x")) / (F.count("*") - 1))
    s = smooth(step, "density", "k").join(step.select("k", "x", "_dx"), "k")
    s = s.withColumn("_mass", reverse_cumsum(s, "smooth", "k") * F.col("_dx")).withColumn("_g", gradient("smooth", "k"))
    g = smooth(s, "_g", "k").select("k", F.col("smooth").alias("_gs"))
    ahead = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(0, window - 1)
    marked = s.join(g, "k").withColumns({"_m": F.avg("_gs").over(ahead), "_x": F.max("_gs").over(ahead), "_c": F.count("*").over(ahead)})
    start = F.coalesce(F.min(F.when(F.col("_mass") <= tail, F.col("k"))), F.max("k"))
    marked = with_totals(marked, _start=start, _last=F.max("k"))
    here = (F.col("k") >= F.col("_start")) & (F.col("k") <= F.col("_last") - window) & (F.col("_c") == window) & (F.col("_x") < 0) & (F.col("_m") < -sensitivity)
    found = marked.agg(F.coalesce(F.min(F.when(here, F.col("k"))), F.first("_start")).alias("k"))
    return found.join(density.select("k", F.col("x").alias("threshold")), "k")


def select_features(effects: DataFrame, threshold: DataFrame, most: int = 200, feature: str = "feature_name") -> DataFrame:
    """Features whose effect reaches the threshold; of more than `most` the largest."""
    chosen = effects.crossJoin(F.broadcast(threshold.select("threshold"))).where("effect_size >= threshold").drop("threshold")
    return chosen.orderBy(F.desc("effect_size"), feature).limit(most)


def varying(df: DataFrame, feature: str = "feature", value: str = "v", least: float = 0.0) -> DataFrame:
    """(feature, variance) of long features whose population variance is above `least`."""
    return df.groupBy(feature).agg(F.var_pop(value).alias("variance")).where(F.col("variance") > least)
