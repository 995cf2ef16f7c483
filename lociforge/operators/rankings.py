"""Orders, choices by rank, contrasts of groups, best combinations."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.series import placed, running, with_totals
from lociforge.sources.shared import kept


def by_significance(df: DataFrame, padj: str = "padj", *ties: str) -> DataFrame:
    """Rows by adjusted p, those without one last."""
    return df.orderBy(F.col(padj).asc_nulls_last(), *ties)


def ascending(df: DataFrame, column: str, *ties: str, absolute: bool = False) -> DataFrame:
    return df.orderBy((F.abs(column) if absolute else F.col(column)).asc_nulls_last(), *ties)


def in_order_of(df: DataFrame, ranking: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of df whose key the ranking has, in its order: highest score first, ties by key."""
    return df.join(ranking.select(key, F.col(score).alias("_score")), key).orderBy(F.desc("_score"), key).drop("_score")


def extreme_rows(df: DataFrame, n: int, score: str, key: str, best: bool = True) -> DataFrame:
    """The n rows with the highest (or lowest) scores, ties by key. Rows without a score are chosen only if there are no others."""
    order = F.col(score).desc_nulls_last() if best else F.col(score).asc_nulls_last()
    return df.orderBy(order, key).limit(n)


def balanced_by_accuracy(a: DataFrame, b: DataFrame, well_a: bool, score: str = "accuracy", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both groups as large as the smaller one: of the larger the lowest scores stay if it is well predicted (a if well_a, else b), else the highest.

    Rows without a score are left out of the larger group where it has any scores at all.
    """
    def cut(df: DataFrame, n: int, best: bool) -> DataFrame:
        known = df.where(F.col(score).isNotNull())
        return extreme_rows(df if known.isEmpty() else known, n, score, key, best)

    n, m = a.count(), b.count()
    return (cut(a, m, not well_a), b) if n > m else (a, cut(b, n, well_a)) if m > n else (a, b)


#: Named contrasts of predicted groups: conditions for each side (fixed names of the study design).
CONTRASTS: dict[str, tuple[str, str]] = {
    "WellPredCaseVsAllCtrl": ("label = 1 AND well", "label = 0"),
    "WellPredCaseVsPoorPredCase": ("label = 1 AND well", "label = 1 AND NOT well"),
    "WellPredCaseVsPoorPredCtrl": ("label = 1 AND well", "label = 0 AND NOT well"),
    "WellPredCaseVsWellPredCtrl": ("label = 1 AND well", "label = 0 AND well"),
    "PoorPredCaseVsAllCtrl": ("label = 1 AND NOT well", "label = 0"),
    "PoorPredCaseVsWellPredCtrl": ("label = 1 AND NOT well", "label = 0 AND well"),
    "AllCasesVsAllCtrl": ("label = 1", "label = 0"),
}


def contrast(df: DataFrame, name: str) -> DataFrame:
    """Rows of (label, well, ...) that a named contrast compares, with side 1 or 0; another name is an error."""
    if name not in CONTRASTS:
        raise ValueError(f"no contrast named {name}")
    one, other = map(F.expr, CONTRASTS[name])
    return df.withColumn("side", F.when(one, 1).when(other, 0)).where("side is not null")


def combined_accuracies(parts: list[DataFrame], column: str = "accuracy_mean", key: str = "id") -> DataFrame:
    """Accuracy tables one below the other, the accuracy under one name, the first row of each id."""
    from lociforge.operators.cohort import keep_first

    out = None
    for k, df in enumerate(parts):
        one = df.withColumnRenamed(column, "accuracy").withColumn("_part", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return keep_first(out, key, F.col("_part"), F.col("accuracy").desc_nulls_last()).drop("_part")


def best_combination(df: DataFrame, columns: list[str], size: int, target: str, most: int = 1000) -> DataFrame:
    """Of the first `most` combinations of `size` columns the one whose best linear mix correlates most with the target.

    One row (columns, r); of equal ones the first. Products are summed in one distributed pass; a combination is a small
    matrix of these, solved on the driver. `most` is the operator's own limit, not a saving.
    """
    every = [*columns, target]
    sums = df.dropna(subset=every).agg(*[F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if j >= i]).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(every))] for i in range(len(every))], float)
    best, chosen = -1.0, ()
    for combo in itertools.islice(itertools.combinations(range(len(columns)), size), most):
        x, y, v = m[np.ix_(combo, combo)], m[list(combo), -1], m[-1, -1]
        r = float(np.sqrt(min(max(y @ np.linalg.lstsq(x, y, rcond=None)[0] / v, 0.0), 1.0))) if v > 0 else 0.0
        if r > best + 1e-12:
            best, chosen = r, combo
    return df.sparkSession.createDataFrame([([columns[k] for k in chosen], best)], "columns array<string>, r double")


def resampled_fdr(scores: DataFrame, permutations: int = 100, seed: int = 42, name: str = "set", es: str = "es", nes: str = "nes") -> DataFrame:
    """Adds fdr: the share of resampled scores of the same sign that are as extreme, over that of the observed ones.

    A resampling draws as many scores as there are, with replacement, and divides them by the mean of their absolute values.
    Rates are at most 1 and never fall from the most extreme score to the least; a score of 0 has none. Draws are digests of
    run, place and seed. What is ranked are the distinct scores of a sign, counted, in ranges.
    """
    spark = scores.sparkSession
    numbered = placed(scores.select(name, es), "_k", [F.col(name)]).withColumn("_k", F.col("_k") - 1)
    total = scores.agg(F.count("*").alias("_n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("#", "run", "place", F.lit(seed))), 1, 8), 16, 10).cast("long") % F.col("_n")
    draws = spark.range(permutations).select(F.col("id").alias("run")).crossJoin(F.broadcast(total)).where("_n > 0").select("run", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("place"))
    drawn = draws.select("run", pick.alias("_k")).join(numbered.select("_k", F.col(es).alias("_es")), "_k")
    mean = drawn.groupBy("run").agg(F.avg(F.abs("_es")).alias("_m"))
    null = drawn.join(mean, "run").where("_m > 0").select(F.signum("_es").alias("_s"), (F.abs("_es") / F.col("_m")).alias("_v"), F.lit(0).alias("_o"), F.lit(1).alias("_r"))
    seen = scores.select(F.signum(nes).alias("_s"), F.abs(nes).alias("_v"), F.lit(1).alias("_o"), F.lit(0).alias("_r"))
    counted = kept(null.unionByName(seen).where("_s <> 0").groupBy("_s", "_v").agg(F.sum("_o").alias("_o"), F.sum("_r").alias("_r")))
    out = None
    for sign in (1.0, -1.0):
        both = with_totals(running(counted.where(F.col("_s") == sign), "_v", {"_co": "_o", "_cr": "_r"}, down=True), _to=F.sum("_o"), _tr=F.sum("_r"))
        rate = both.where("_o > 0").select("_s", "_v", (-(F.col("_cr") / F.nullif(F.col("_tr"), F.lit(0))) / (F.col("_co") / F.col("_to"))).alias("_q"))
        one = running(rate, "_v", {"_least": "_q"}, down=True, least=True).select("_s", "_v", F.least(F.lit(1.0), -F.col("_least")).alias("fdr"))
        out = one if out is None else out.unionByName(one)
    return scores.withColumns({"_s": F.signum(nes), "_v": F.abs(nes)}).join(out, ["_s", "_v"], "left").drop("_s", "_v")


def all_but_last(df: DataFrame, n: int, order: str) -> DataFrame:
    """All rows but the n last in that order (nulls last); `order` is a unique key. The n last are found without sorting the rest."""
    last = df.select(F.col(order).alias("_last")).orderBy(F.desc_nulls_first("_last")).limit(n)
    return df.join(last, F.col(order).eqNullSafe(F.col("_last")), "left_anti")


def top_by(df: DataFrame, n: int, group: str, value: str, *ties: str) -> DataFrame:
    """The first n rows by group, then by descending absolute value, then by the ties."""
    return df.orderBy(group, F.abs(value).desc(), *ties).limit(n)
