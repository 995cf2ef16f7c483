"""Expression counts (gene_id, sample_id, count) and ranked gene lists."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.functions.series import placed
from lociforge.operators.cohort import drawn
from lociforge.sources.shared import kept


def size_factors(counts: DataFrame, gene: str = "gene_id", sample: str = "sample_id", count: str = "count") -> DataFrame:
    """Median of ratios: each sample's median over genes, positive in all samples, of its count over the gene's geometric mean."""
    n = counts.agg(F.count_distinct(sample).alias("_n"))
    genes = counts.where(F.col(count) > 0).groupBy(gene).agg(F.avg(F.ln(count)).alias("_log"), F.count_distinct(sample).alias("_k"))
    complete = genes.crossJoin(F.broadcast(n)).where("_k = _n").select(gene, "_log")
    return counts.join(complete, gene).groupBy(sample).agg(F.exp(F.percentile(F.ln(count) - F.col("_log"), 0.5)).alias("size_factor"))


def enrichment(ranked: DataFrame, sets: DataFrame, gene: str = "gene", score: str = "score", name: str = "set", least: int = 3, most: int = 1000) -> DataFrame:
    """Enrichment score of each set over a ranked list (weight 1): the largest deviation of the running sum.

    Between members the running sum falls evenly, so it is enough to look right before and after each member: the list is
    joined with the sets, never crossed with them. Returns name, size, es.
    """
    return _enriched(_ranks(ranked, gene, score), sets, name, least, most)


def _ranks(ranked: DataFrame, gene: str, score: str) -> DataFrame:
    """_g, _w, _r: a ranked list's genes with their weights and places."""
    rows = ranked.select(F.col(gene).alias("_g"), F.col(score).alias("_s"))
    return placed(rows, "_r", [F.desc("_s"), F.asc("_g")]).select("_g", F.abs("_s").alias("_w"), "_r")


def _enriched(ranks: DataFrame, sets: DataFrame, name: str, least: int, most: int) -> DataFrame:
    members = sets.select(name, F.explode("genes").alias("_g")).distinct().join(ranks, "_g").withColumn("size", F.count("*").over(W.partitionBy(name)))
    return _deviations(members.where(F.col("size").between(least, most)), ranks, [name]).select(name, "size", "es")


def _deviations(members: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, es) of members (by, size, _r, _w): the largest deviation of each running sum over the ranked list."""
    s = W.partitionBy(*by, "size")
    up = s.orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    m = members.select(*by, "size", "_r", "_w", F.sum("_w").over(up).alias("_hit"), F.sum("_w").over(s).alias("_all"), F.count("*").over(up).alias("_k"))
    m = m.crossJoin(F.broadcast(ranks.agg(F.count("*").alias("_n")))).where((F.col("size") < F.col("_n")) & (F.col("_all") > 0))
    miss = (F.col("_r") - F.col("_k")) / (F.col("_n") - F.col("size"))
    after, before = F.col("_hit") / F.col("_all") - miss, (F.col("_hit") - F.col("_w")) / F.col("_all") - miss
    peaks = m.groupBy(*by, "size").agg(F.max(after).alias("_up"), F.min(before).alias("_down"))
    return peaks.select(*by, "size", F.when(F.abs("_up") >= F.abs("_down"), F.col("_up")).otherwise(F.col("_down")).alias("es"))


def normalised_scores(scores: DataFrame, es: str = "es") -> DataFrame:
    """Adds nes: positive scores over their mean, others over the mean size of the negative ones (1 where there are none)."""
    x = F.col(es)
    t = scores.agg(F.coalesce(F.avg(F.when(x > 0, x)), F.lit(1.0)).alias("_p"), F.coalesce(F.avg(F.when(x < 0, -x)), F.lit(1.0)).alias("_m"))
    return scores.crossJoin(F.broadcast(t)).withColumn("nes", F.when(x >= 0, x / F.col("_p")).otherwise(x / F.col("_m"))).drop("_p", "_m")


def binned_mutual_information(df: DataFrame, a: str, b: str, bins: int = 8) -> DataFrame:
    """Mutual information of two columns in equal-width bins (an approximation of nearest-neighbour estimates), in nats."""
    t = df.dropna(subset=[a, b])
    edge = t.agg(*[f(c).alias(f"_{n}{k}") for k, c in enumerate((a, b)) for n, f in (("low", F.min), ("high", F.max))])
    at = lambda c, k: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"_low{k}")) * bins / F.nullif(F.col(f"_high{k}") - F.col(f"_low{k}"), F.lit(0))))
    cells = t.crossJoin(F.broadcast(edge)).groupBy(at(a, 0).alias("x"), at(b, 1).alias("y")).agg(F.count("*").alias("n"))
    w = lambda *c: F.sum("n").over(W.partitionBy(*c or (F.lit(0),)))
    p = cells.select("n", w("x").alias("nx"), w("y").alias("ny"), w().alias("all"))
    return p.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi"))


def differential_expression(counts: DataFrame, factors: DataFrame, groups: DataFrame, gene: str = "gene_id", sample: str = "sample_id", count: str = "count", group: str = "group") -> DataFrame:
    """Negative binomial two-group test of each gene: base_mean, log2_fold_change (group 1 over 0), se, p of a Wald test, padj.

    One pass of grouped sums: with a group's size factors as exposures the maximum-likelihood mean of a two-group design is
    the ratio of sums, and the dispersion comes from the moments of normalised counts within groups (at least 1e-8). A gene
    with counts in one group only, or in none, has null results.
    """
    from lociforge.functions.series import bh_adjust

    x = counts.join(factors, sample).join(groups, sample).withColumn("_q", F.col(count) / F.col("size_factor"))
    s = x.groupBy(gene, group).agg(F.sum(count).alias("y"), F.sum("size_factor").alias("s"), F.sum("_q").alias("q"), F.sum(F.col("_q") * F.col("_q")).alias("qq"), F.sum(1 / F.col("size_factor")).alias("i"), F.count("*").alias("n"))
    side = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c))).cast("double")
    w = s.groupBy(gene).agg(*[side(g, c).alias(f"{c}{g}") for g in (0, 1) for c in ("y", "s", "q", "qq", "i", "n")])
    c = F.col
    n = c("n0") + c("n1")
    base = (c("q0") + c("q1")) / n
    within = ((c("qq0") - c("q0") * c("q0") / c("n0")) + (c("qq1") - c("q1") * c("q1") / c("n1"))) / F.nullif(n - 2, F.lit(0.0))
    alpha = F.greatest(F.lit(1e-8), (within - base * (c("i0") + c("i1")) / n) / (base * base))
    m0, m1 = c("y0") / c("s0"), c("y1") / c("s1")
    lfc = F.ln(m1 / m0)
    var = 1 / c("y0") + 1 / c("y1") + c("alpha") * (1 / c("n0") + 1 / c("n1"))
    good = w.where("y0 > 0 and y1 > 0").withColumn("base_mean", base).withColumn("alpha", alpha).select(gene, "base_mean", "alpha", (lfc / math.log(2)).alias("log2_fold_change"), (F.sqrt(var) / math.log(2)).alias("se"))
    good = good.withColumn("p", _two_sided(F.abs(F.col("log2_fold_change") / F.col("se"))))
    return w.select(gene).join(bh_adjust(good), gene, "left")


#: Coefficients of the fit below, highest power first (fixed values).
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _two_sided(z: Column) -> Column:
    """Probability of a standard normal value at least z from 0; relative error below 2e-7 (a rational Chebyshev fit of erfc)."""
    t = 1 / (1 + 0.5 * z / math.sqrt(2))
    poly = F.lit(0.0)
    for a in ERFC:
        poly = poly * t + a
    return F.least(F.lit(1.0), t * F.exp(poly - z * z / 2))


def permutation_null(predictions: DataFrame, n: int, seed: int = 42, label: str = "label", p: str = "y_pred", key: str = "sample_id") -> DataFrame:
    """Balanced accuracy under n random relabellings: (run, balanced_accuracy); run 0 has the true labels.

    Samples are numbered once by their ids; in each run the one that is n-th so gets the label of the n-th in a seeded order,
    whose places are dealt out by digests.
    """
    own = kept(placed(predictions.select(key, label, p), "_n", [F.lpad(F.col(key).cast("string"), 32, "0")]))
    runs = own.crossJoin(F.broadcast(predictions.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("run"))))
    digest = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(seed), F.col("run")))
    other = drawn(runs.select("run", key, F.col(label).alias("_y")), ["run"], key, seed, digest).select("run", "_y", "_n")
    hit = runs.join(other, ["run", "_n"]).select("run", "_y", (F.col(p) > 0.5).cast("int").alias("_h"))
    hit = own.select(F.lit(0).alias("run"), F.col(label).alias("_y"), (F.col(p) > 0.5).cast("int").alias("_h")).unionByName(hit)
    return hit.groupBy("run").agg(((F.avg(F.when(F.col("_y") == 1, F.col("_h"))) + F.avg(F.when(F.col("_y") == 0, 1 - F.col("_h")))) / 2).alias("balanced_accuracy"))


def null_scores(ranks: DataFrame, sizes: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(size, run, es) of random gene sets of each size in `sizes`: their genes' places in the ranking are digests of size, run and number.

    A place that comes again does not count, so as many numbers are drawn as leave enough places, but for one case in millions,
    which is an error. What a set's score hangs on is its size alone: sets of one size share their random sets.
    """
    total = ranks.agg(F.count("*").alias("_n"))
    n, size = F.col("_n"), F.col("size")
    numbers = F.ceil(-n * F.ln(1 - size / (n + 1)) + 8 * F.sqrt(size) + 20).cast("int")
    runs = sizes.where(size.isNotNull()).select("size").distinct().crossJoin(F.broadcast(total)).where(size < n).select("size", "_n", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("run"))
    place = F.conv(F.substring(F.md5(F.concat_ws("#", "size", "run", "_k", F.lit(seed))), 1, 12), 16, 10).cast("long") % n + 1
    places = runs.repartition("size", "run").select("size", "run", "_n", F.explode(F.sequence(F.lit(1), numbers)).alias("_k")).select("size", "run", "_k", place.alias("_r"))
    first = places.groupBy("size", "run", "_r").agg(F.min("_k").alias("_k"))
    w = W.partitionBy("size", "run")
    chosen = first.select("*", F.row_number().over(w.orderBy("_k")).alias("_i"), F.count("*").over(w).alias("_c")).where(F.col("_i") <= size)
    short = F.raise_error(F.concat(F.lit("too few distinct places for sets of "), size.cast("string"))).cast("long")
    chosen = chosen.select(F.when(F.col("_c") < size, short).otherwise(size).alias("size"), "run", "_r")
    return _deviations(chosen.join(ranks.select("_r", "_w"), "_r"), ranks, ["run"]).select("size", "run", "es")


def enrichment_p_values(ranked: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 42, gene: str = "gene", score: str = "score", name: str = "set", least: int = 3, most: int = 1000) -> DataFrame:
    """name, size, es, nes, p: enrichment scores against those of random gene sets of the same size.

    p is the share of random sets, of those whose score has the sign of es, that score as far from 0; nes is es over their
    mean distance. Where no random set has that sign p is 1 and nes null. Scores of random sets are made once for each size.
    """
    ranks = kept(_ranks(ranked, gene, score))
    scored = kept(_enriched(ranks, sets, name, least, most))
    null = null_scores(ranks, scored.select("size"), permutations, seed).select("size", (F.col("es") >= 0).alias("_up"), F.abs("es").alias("_e"))
    # equal scores of a size are one row, counted, however many sets have that size
    null = kept(null.groupBy("size", "_up", "_e").agg(F.count("*").alias("_c")))
    own = scored.withColumn("_up", F.col("es") >= 0)
    met = own.select(name, "size", "_up", F.abs("es").alias("_own")).join(null, ["size", "_up"])
    told = met.groupBy(name).agg((F.sum(F.when(F.col("_e") >= F.col("_own"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("p"), (F.sum(F.col("_e") * F.col("_c")) / F.sum("_c")).alias("_m"))
    return own.join(told, name, "left").select(name, "size", "es", (F.col("es") / F.nullif(F.col("_m"), F.lit(0.0))).alias("nes"), F.coalesce("p", F.lit(1.0)).alias("p"))


def multiple_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Correlation of a target with its best linear combination of columns (canonical correlation with one target).

    Sums of products are built in one distributed pass; only the small matrix of these is solved on the driver.
    """
    every = [*columns, target]
    sums = df.dropna(subset=every).agg(*[F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if j >= i]).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(every))] for i in range(len(every))], float)
    x, y, v = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    r2 = float(y @ np.linalg.lstsq(x, y, rcond=None)[0] / v) if v > 0 else 0.0
    return df.sparkSession.createDataFrame([(float(np.sqrt(min(max(r2, 0.0), 1.0))),)], "r double")


def mean_threshold_selection(train: DataFrame, names: list[str], model: str = "elastic_net") -> list[str]:
    """Fits a model of the stack on (label, features) and keeps the features whose absolute importance reaches the mean."""
    from lociforge.operators.models import fit, importances

    return above_mean_features(importances(fit(train, model), names) or [])


def above_mean_features(importances: list[tuple[str, float]]) -> list[str]:
    """Features whose absolute importance reaches the mean of all."""
    size = [abs(v) for _, v in importances]
    return [n for n, v in importances if size and abs(v) >= sum(size) / len(size)]


def regulated_counts(df: DataFrame, change: str = "log2_fold_change", p: str = "padj", alpha: float = 0.05, middle: float = 0.0) -> DataFrame:
    """One row: how many significant genes change up and down; a null p or change counts for neither."""
    significant = F.col(p) < alpha
    return df.agg(F.count_if(significant & (F.col(change) > middle)).alias("up"), F.count_if(significant & (F.col(change) < middle)).alias("down"))


def stratum_counts(df: DataFrame, draw: str, by: list[str]) -> DataFrame:
    """(by, mean, std, least): rows of each stratum over the draws that have any, with the population deviation."""
    counts = df.groupBy(draw, *by).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.avg("_n").alias("mean"), F.stddev_pop("_n").alias("std"), F.min("_n").alias("least"))
