"""Joins of points with closed intervals.

A range condition alone would compare every point with every interval. Bins of growing width, each eight times the one
below, make a hierarchy, and an interval is one row however long it is: under the smallest bin that holds it whole. A
point looks up its bin of every level, so the two meet on (contig, level, bin): an equi-join that hash or sort-merge joins
and skew handling apply to. The exact condition remains as a residual. Only contigs and positions take part in it;
whatever else the points carry is kept out, and reached by a join on what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of bins above which one bin holds a whole contig, and by how many bits each is wider than the one below.
LEVELS, BITS = 8, 3


def _bin(position: Column, width: int, level: int) -> Column:
    return F.floor(position / F.lit(width << BITS * level)).cast("long") if level < LEVELS else F.lit(0).cast("long")


def placed_intervals(intervals: DataFrame, width: int, start: str, end: str) -> DataFrame:
    """Adds level and bin of the smallest bin that holds each interval; those that end before they start, and nulls, are left out."""
    a, b = F.col(start), F.col(end)
    level = F.coalesce(*[F.when(_bin(a, width, k) == _bin(b, width, k), k) for k in range(LEVELS)], F.lit(LEVELS))
    by_level = F.coalesce(*[F.when(F.col("level") == k, _bin(a, width, k)) for k in range(LEVELS)], _bin(a, width, LEVELS))
    return intervals.where(a <= b).withColumn("level", level).withColumn("bin", by_level)


def _looked_up(points: DataFrame, width: int, pos: str, reach: int = 0) -> DataFrame:
    """A row for each bin, of every level, that a point (to pos + reach) touches."""
    def bins(level: int) -> Column:
        touched = F.sequence(_bin(F.col(pos), width, level), _bin(F.col(pos) + reach, width, level))
        return F.transform(touched, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    touched = [bins(k) for k in range(LEVELS + 1)]
    return points.where(F.col(pos).isNotNull()).select("*", F.explode(F.flatten(F.array(*touched))).alias("_at")).select("*", "_at.level", "_at.bin").drop("_at")


def interval_semi_join(points: DataFrame, intervals: DataFrame, width: int = 1000, pos: str = "pos", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Points inside at least one interval of their contig; no point is repeated. Null positions are inside none."""
    i = placed_intervals(intervals.select(F.col("contig").alias("i_contig"), F.col(start).alias("i_start"), F.col(end).alias("i_end")), width, "i_start", "i_end").withColumnsRenamed({"level": "i_level", "bin": "i_bin"})
    p = _looked_up(points.select("contig", F.col(pos).alias("_pos")), width, "_pos")
    inside = (F.col("contig") == F.col("i_contig")) & (F.col("level") == F.col("i_level")) & (F.col("bin") == F.col("i_bin")) & F.col("_pos").between(F.col("i_start"), F.col("i_end"))
    found = p.join(i, inside, "left_semi").select(F.col("contig").alias("_contig"), "_pos").distinct()
    return points.join(found, (points["contig"] == found["_contig"]) & (points[pos] == found["_pos"]), "left_semi")


def overlap_names(points: DataFrame, intervals: DataFrame, name: str = "gene_name", width: int = 1000, pos: str = "pos", reach: int = 1, missing: str = "N/A") -> DataFrame:
    """For each point (contig, pos) the sorted names of the intervals that pos to pos + reach overlaps, comma-joined."""
    p = _looked_up(points.select("contig", pos).distinct(), width, pos, reach)
    i = placed_intervals(intervals.select("contig", "start_pos", "end_pos", name), width, "start_pos", "end_pos")
    hit = p.join(i, ["contig", "level", "bin"]).where((F.col(pos) <= F.col("end_pos")) & (F.col(pos) + reach >= F.col("start_pos")))
    names = hit.groupBy("contig", pos).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))
    return points.join(names, ["contig", pos], "left").withColumn("names", F.coalesce("names", F.lit(missing)))
