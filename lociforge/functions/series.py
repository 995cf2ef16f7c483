"""Numeric operators over ordered series and columns: sums, gradients, smoothing, scaling, ranks, corrections.

A series has a unique position column. Its windows go over all positions in one task: these are grids of at most some
thousands of points that were aggregated before. With `by` each group is a series of its own. What runs over as many values
as there may be rows (scores, p values, ranks) is dealt to ranges: each is summed, and shifted by the ranges before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.sources.shared import kept

#: Gaussian weights at distances 0 to 4 for a deviation of 1, normed over -4 to 4.
_RAW = [math.exp(-0.5 * k * k) for k in range(5)]
GAUSS = [w / (_RAW[0] + 2 * sum(_RAW[1:])) for w in _RAW]


def _series(by: tuple[str, ...], *order: Column | str):
    return W.partitionBy(*by or (F.lit(0),)).orderBy(*order)


def reverse_cumsum(df: DataFrame, value: str, position: str, by: tuple[str, ...] = ()) -> Column:
    """Sum of a value and all at later positions."""
    return F.sum(value).over(_series(by, F.desc(position)).rowsBetween(W.unboundedPreceding, 0))


def gradient(value: str, position: str, by: tuple[str, ...] = ()) -> Column:
    """Central differences, one-sided at the ends."""
    w = _series(by, position)
    a, b, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.coalesce((b - a) / 2, b - x, x - a)


def smooth(df: DataFrame, value: str, position: str) -> DataFrame:
    """Adds smooth: Gaussian smoothing with a deviation of 1 over 4 neighbours on each side; edges are mirrored (d c b a | a b c d)."""
    n = df.count()
    points = df.select(position, value, (F.row_number().over(_series((), position)) - 1).alias("_i"))
    offsets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(GAUSS[abs(k)]).alias("w")) for k in range(-4, 5)]))
    want = points.select("_i", offsets.alias("o")).select("_i", "o.w", (F.pmod(F.col("_i") + F.col("o.k"), F.lit(2 * n))).alias("_m"))
    source = F.when(F.col("_m") >= n, 2 * n - 1 - F.col("_m")).otherwise(F.col("_m"))
    mixed = want.select("_i", "w", source.alias("_s")).join(points.select(F.col("_i").alias("_s"), F.col(value).alias("_v")), "_s").groupBy("_i").agg(F.sum(F.col("w") * F.col("_v")).alias("smooth"))
    return points.join(mixed, "_i").select(position, value, "smooth")


def running_min(value: str, *order: Column | str, by: tuple[str, ...] = ()) -> Column:
    return F.min(value).over(_series(by, *order).rowsBetween(W.unboundedPreceding, 0))


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates over all rows as columns. Partial sums and one broadcast row, where a window would need one task."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in totals.items()])))


def min_max(df: DataFrame, value: str, into: str = "scaled", constant: float = 0.0) -> DataFrame:
    """Adds the value scaled to [0, 1]; `constant` where all values are equal."""
    x = F.col(value)
    t = with_totals(df, _low=F.min(x), _high=F.max(x))
    return t.withColumn(into, F.coalesce((x - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)), F.when(x.isNotNull(), F.lit(constant)))).drop("_low", "_high")


def min_max_apply(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Other rows scaled by the range of the training rows."""
    lows = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_low_{c}")) / F.nullif(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(0)), F.lit(0.0)) for c in columns}
    return other.crossJoin(F.broadcast(lows)).withColumns(scaled).drop(*lows.columns)


def z_score(df: DataFrame, value: Column, into: str = "z") -> DataFrame:
    """Adds the value less its mean over the population deviation."""
    t = with_totals(df, _mean=F.avg(value), _sd=F.stddev_pop(value))
    return t.withColumn(into, (value - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd")


def exact_mean(value: str) -> Column:
    """Mean of a column of doubles, summed as decimals: the same in any order of the rows, so that equal means are equal."""
    return F.sum(F.col(value).cast("decimal(38,20)")).cast("double") / F.count(value)


def ranged(df: DataFrame, value: str, into: str = "_part") -> DataFrame:
    """Adds the number of a value's range, ranges being in order and about equally full; equal values share one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return df.withColumn(into, F.lit(0))
    cuts = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 10_000).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    return df.crossJoin(F.broadcast(cuts)).withColumn(into, part).drop("_cuts")


def running(df: DataFrame, order: str, into: dict[str, str], down: bool = False, least: bool = False) -> DataFrame:
    """Adds running sums (or minima) of columns, {name: column}, from the smallest order value up, or from the largest down.

    Order values are unique. No task sees more than a range of them; what goes to all is one row for each range.
    """
    f, step = (F.min if least else F.sum), (F.desc if down else F.asc)
    r = ranged(df, order)
    ahead = W.partitionBy(F.lit(0)).orderBy(step("_part")).rowsBetween(W.unboundedPreceding, -1)
    totals = r.groupBy("_part").agg(*[f(c).alias(f"_t_{n}") for n, c in into.items()])
    shifts = totals.select("_part", *[f(f"_t_{n}").over(ahead).alias(f"_s_{n}") for n in into])
    inside = W.partitionBy("_part").orderBy(step(order)).rowsBetween(W.unboundedPreceding, 0)
    both = lambda n, c: F.least(f(c).over(inside), f"_s_{n}") if least else f(c).over(inside) + F.coalesce(f"_s_{n}", F.lit(0))
    return r.join(F.broadcast(shifts), "_part").select(*df.columns, *[both(n, c).alias(n) for n, c in into.items()])


def global_rank(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds the place of a row in the order of a value, from 1; equal values in any order."""
    r = ranged(df, value)
    sizes = r.groupBy("_part").agg(F.count("*").alias("_size"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(value))
    return r.join(F.broadcast(shifts), "_part").select(*df.columns, (inside + F.col("_before")).alias(into))


def placed(df: DataFrame, into: str, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a row's place, from 1, in the given order of all rows, or of its group.

    Rows are sorted in ranges of group and order, once, into a table in the shared folder; a place is that in the range and
    the rows of the group in the ranges before. So a group of any size is spread, as far as the order tells its rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in by]
    parts = kept(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    names = {c: f"_by{k}" for k, c in enumerate([*by, "_part"])}
    sizes = parts.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in names.items()]).agg(F.count("*").alias("_c"), F.min("_at").alias("_from"))
    ahead = W.partitionBy(*[names[c] for c in by] or [F.lit(0)]).orderBy(names["_part"]).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*names.values(), "_from", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    on = F.lit(True)
    for c, k in names.items():
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return parts.join(sizes, on).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_from") + F.col("_before") + 1).alias(into))


def average_rank(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds the rank of a value, ties sharing their mean rank.

    Ranks come from counted distinct values: the window runs over these, and the rows meet their rank in a join. The rows are
    read twice, so a value must be the same each time: a sum of doubles, whose last digits hang on the order in which its parts
    arrive, is kept or exact first.
    """
    counts = running(df.where(F.col(value).isNotNull()).groupBy(value).count(), value, {"_upto": "count"})
    return df.join(counts.select(value, (F.col("_upto") - F.col("count") + (F.col("count") + 1) / 2).alias(into)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(kept(df.select(a, b)), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"))


def bh_adjust(df: DataFrame, p: str = "p", first: bool = False) -> DataFrame:
    """Adds padj: p times n over rank, made monotone from the largest p down, 1 at most; null p stays null and is not counted.

    Equal p have the last of their ranks or, if `first`, the first, as rank() has it. The rows are read twice, so p must be the
    same each time (kept, or not a sum of doubles).
    """
    known = running(df.where(F.col(p).isNotNull()).groupBy(p).count(), p, {"_rank": "count"})
    rank = F.col("_rank") - F.col("count") + 1 if first else F.col("_rank")
    raw = with_totals(known, _n=F.sum("count")).select(p, (F.col(p) * F.col("_n") / rank).alias("_q"))
    adjusted = running(raw, p, {"_least": "_q"}, down=True, least=True).select(p, F.least(F.lit(1.0), "_least").alias("padj"))
    return df.join(adjusted, p, "left")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Density in equal bins from the smallest to the largest value: (bin, left, density). Empty bins are listed.

    Where all values are equal the bins go from half below to half above them. Without values there are no bins.
    """
    t = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n")).where("_n > 0")
    half = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    t = t.select((F.col("_low") - half).alias("_low"), (F.col("_high") + half).alias("_high"), "_n")
    width = (F.col("_high") - F.col("_low")) / bins
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / width))
    counted = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(t)).groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("_c"))
    grid = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("_low") + F.col("bin") * width).alias("left"), (F.coalesce("_c", F.lit(0)) / (F.col("_n") * width)).alias("density"))
