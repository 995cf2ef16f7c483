"""Exact quantiles by distributed selection.

`percentile` keeps a count for each distinct value of a group in one task. Here the order is narrowed: cut points of a
sketch part a group into ranges, the ranges are counted, and only those that hold a rank which is asked for are looked at
again, each as a group of its own. Sketches only say where to cut; all counts are exact, and so is the result. A pass
leaves about 1 / CUTS of the rows for each rank, so all rows are read twice, the rest is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.sources.shared import kept

CUTS = 64


def _ranks(n: Column, at: list[float]) -> Column:
    """The places, from 0, of the values between which each quantile of n values lies."""
    each = [(n - 1) * F.lit(q) for q in at]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in each for f in (F.floor, F.ceil)]))


def _ahead(counts: DataFrame) -> DataFrame:
    """Counted ranges (key, bin, n) with the rows of their group in the ranges before. A group has CUTS + 1 ranges at most."""
    return counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def narrowed(rows: DataFrame, wanted: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, value) and wanted (key, group, rank, left), left being the place in its key's order, narrowed.

    Returns found (group, rank, value), and what is left of rows and wanted: keys of at most `most` rows. A key of more is
    parted, its ranges becoming keys; one of equal values only is found.
    """
    found = None
    while True:
        shape = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        large = kept(shape.where(F.col("n") > most))
        same = large.where("low = high").select("key", F.col("low").alias("value"))
        done = kept(wanted.join(same, "key").select("group", "rank", "value"))
        found = done if found is None else found.unionByName(done)
        parted = large.where("low < high").select("key")
        if parted.isEmpty():
            return found, rows.join(large.select("key"), "key", "left_anti"), wanted
        of_large = rows.join(parted, "key", "left_semi")
        cuts = of_large.groupBy("key").agg(F.percentile_approx("value", [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("cuts"), F.min("value").alias("low"))
        # a range ends with its cut; the least value is a cut, too, so that a frequent one is parted from the others
        cuts = kept(cuts.select("key", F.array_distinct(F.concat(F.array("low"), "cuts")).alias("cuts")))
        bins = kept(of_large.join(cuts, "key").select("key", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("bin"), "value"))
        counts = _ahead(bins.groupBy("key", "bin").agg(F.count("*").alias("n")))
        inside = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n"))
        placed = wanted.join(counts, "key").where(inside).select(F.struct("key", "bin").alias("k"), "group", "rank", (F.col("left") - F.col("before")).alias("left"))
        rest = wanted.join(large.select("key"), "key", "left_anti")
        within = bins.select(F.struct("key", "bin").alias("k"), "value").join(placed.select("k").distinct(), "k", "left_semi")
        small = rows.join(large.select("key"), "key", "left_anti")
        digest = F.sha2(F.concat(F.col("k.key"), F.lit("/"), F.col("k.bin").cast("string")), 256).alias("key")
        wanted = kept(placed.select(digest, "group", "rank", "left").unionByName(rest.select("key", "group", "rank", "left")))
        rows = kept(within.select(digest, "value").unionByName(small.select("key", "value")))

def selected(rows: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(group, rank, value) of what is wanted; no task orders more than `most` values of a key."""
    found, rows, wanted = narrowed(rows, wanted, most)
    upto = rows.groupBy("key", "value").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("key").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    inside = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
    return found.unionByName(wanted.join(upto, "key").where(inside).select("group", "rank", "value"))


def quantiles(df: DataFrame, value: str, at: list[float], by: tuple[str, ...] = (), most: int = 100_000) -> DataFrame:
    """(by, n, quantiles): for each group the quantiles `at`, between values where they fall there, as `percentile` gives them.

    Null values do not count; NaN is the largest value. A group without values, like an empty table, has no row. Values
    are ordered as doubles. No task orders more than `most` values, however many a group has; groups of any number and
    size are handled together, and a value that fills a group costs one count. Where no group has more than `most`
    values, that is the built-in aggregate's bound as well, and it is taken.
    """
    names = [f"_by{k}" for k in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], F.col(value).cast("double").alias("value"))
    groups = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 0")
    own = [F.col(n).alias(c) for c, n in zip(by, names, strict=True)]
    if groups.where(F.col("n") > most).isEmpty():
        each = rows.groupBy(*names).agg(F.count("*").alias("n"), F.percentile("value", F.array(*map(F.lit, at))).alias("quantiles"))
        return each.where("n > 0").select(*own, "n", "quantiles")
    groups = kept(groups.withColumn("group", F.monotonically_increasing_id()))
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(groups[n])
    numbered = kept(rows.join(groups, same).select(F.col("group").cast("string").alias("key"), "value"))
    wanted = groups.select(F.col("group").cast("string").alias("key"), "group", F.explode(_ranks(F.col("n"), at)).alias("rank")).withColumn("left", F.col("rank"))
    values = selected(numbered, kept(wanted), most).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))

    def between(q: float) -> Column:
        x = (F.col("n") - 1) * F.lit(q)
        low, high = (F.element_at("v", f(x).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return groups.join(values, "group").select(*own, "n", F.array(*map(between, at)).alias("quantiles"))
