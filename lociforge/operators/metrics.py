"""Scores of predictions (label 0/1, y_pred): per row, aggregated, and as curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.functions.series import running, with_totals
from lociforge.operators.quantiles import quantiles

#: Probabilities are kept this far from 0 and 1 in logarithms (a fixed value).
EPSILON = 1e-15


def above(p: Column) -> Column:
    """Class of a probability in evaluations: over one half."""
    return (p > 0.5).cast("int")


def at_least(p: Column) -> Column:
    """Class of a probability in feature selection: one half or more."""
    return (p >= 0.5).cast("int")


def rounded(p: Column) -> Column:
    """Class of a probability by rounding half to even."""
    return F.bround(p).cast("int")


def sample_scores(df: DataFrame, label: str = "label", p: str = "y_pred") -> DataFrame:
    """Adds brier, log_loss and accuracy of each row."""
    y, q = F.col(label), F.col(p)
    safe = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), q))
    return df.withColumns({"brier": (y - q) * (y - q), "log_loss": -(y * F.ln(safe) + (1 - y) * F.ln(1 - safe)), "accuracy": above(q) == y})


def confusion(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", p: str = "y_pred") -> DataFrame:
    """Counts tn, fp, fn, tp in one pass."""
    y, hit = F.col(label), above(F.col(p))
    count = lambda a, b: F.count_if((y == a) & (hit == b))
    return df.groupBy(*by).agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))


def classifier_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, F1, MCC, accuracies of cases and controls, balanced accuracy; 0 where a denominator is."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    case, control = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return confusion(df, by).withColumns(
        {
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
            "case_accuracy": case,
            "control_accuracy": control,
            "balanced_accuracy": (case + control) / 2,
        }
    )


def row_normalised(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares of each true class over summed confusion counts; null for a class without rows."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    control, case = F.nullif(F.col("tn") + F.col("fp"), F.lit(0)), F.nullif(F.col("fn") + F.col("tp"), F.lit(0))
    return s.select(*by, (F.col("tn") / control).alias("tn"), (F.col("fp") / control).alias("fp"), (F.col("fn") / case).alias("fn"), (F.col("tp") / case).alias("tp"))


def score_counts(df: DataFrame, label: str = "label", p: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Cases and controls at each distinct score: what all curves are made of."""
    return df.groupBy(*by, F.col(p).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def cumulative(df: DataFrame, label: str = "label", p: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """pos and neg at each distinct score, their sums tps and fps from the highest score down, and the totals.

    Scores are summed in ranges, so continuous ones may be as many as rows. With `by`, each group's are in one task.
    """
    counts = score_counts(df, label, p, by)
    if not by:
        return with_totals(running(counts, "threshold", {"tps": "pos", "fps": "neg"}, down=True), n_pos=F.sum("pos"), n_neg=F.sum("neg"))
    w = W.partitionBy(*by)
    down = w.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    s = F.sum
    return counts.select("*", s("pos").over(down).alias("tps"), s("neg").over(down).alias("fps"), s("pos").over(w).alias("n_pos"), s("neg").over(w).alias("n_neg"))


def _share(part: str, whole: str) -> Column:
    """part / whole; null where the whole is 0."""
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def roc_curve(df: DataFrame, **names) -> DataFrame:
    """False and true positive rates at each distinct score. Points on a line with their neighbours stay. Without controls (cases) the first (second) is null."""
    return cumulative(df, **names).select("threshold", _share("fps", "n_neg").alias("fpr"), _share("tps", "n_pos").alias("tpr"))


def roc_auc(df: DataFrame, **names) -> DataFrame:
    """Area under the curve, by trapezoids from (0, 0): a score's step is its own cases and controls. Null if only one class is there."""
    area = F.col("neg") * (2 * F.col("tps") - F.col("pos")) / F.nullif(2 * F.col("n_neg") * F.col("n_pos"), F.lit(0))
    return cumulative(df, **names).agg(F.sum(area).alias("auc"))


def pr_curve(df: DataFrame, **names) -> DataFrame:
    """Precision and recall at each distinct score; recall is null without cases."""
    return cumulative(df, **names).select("threshold", (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), _share("tps", "n_pos").alias("recall"))


def average_precision(df: DataFrame, **names) -> DataFrame:
    """Sum over scores of the gain in recall times the precision; null without cases."""
    return cumulative(df, **names).agg(F.sum(_share("pos", "n_pos") * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("ap"))


def mean_roc(df: DataFrame, run: str = "run_id", points: int = 100) -> DataFrame:
    """Mean true positive rate over runs on an even grid of false positive rates, and the band of one deviation, cut to [0, 1].

    Each run's curve is read off the grid by linear interpolation between its points; at equal rates the highest counts. A run
    with one class only has no curve and is left out.
    """
    curve = cumulative(df, by=(run,)).where("n_neg > 0 and n_pos > 0").select(run, _share("fps", "n_neg").alias("x"), _share("tps", "n_pos").alias("y"))
    curve = curve.groupBy(run, "x").agg(F.max("y").alias("y"))
    zero = curve.select(run).distinct().select(run, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    w = W.partitionBy(run).orderBy("x")
    curve = curve.unionByName(zero).groupBy(run, "x").agg(F.max("y").alias("y"))
    steps = curve.select(run, "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    # the grid points of a step are listed from its ends, so no point is compared with every step
    first, last = F.ceil(F.col("x") * (points - 1)), F.when(F.col("x1").isNull(), F.lit(points - 1)).otherwise(F.ceil(F.col("x1") * (points - 1)) - 1)
    on = steps.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    g = F.col("k") / (points - 1)
    at = F.when(F.col("x1").isNull() | (g == F.col("x")), F.col("y")).otherwise(F.col("y") + (F.col("y1") - F.col("y")) * (g - F.col("x")) / (F.col("x1") - F.col("x")))
    mean = on.select("k", at.alias("y")).groupBy("k").agg(F.avg("y").alias("tpr"), F.stddev_pop("y").alias("sd"))
    return mean.select((F.col("k") / (points - 1)).alias("fpr"), "tpr", F.least(F.lit(1.0), F.col("tpr") + F.col("sd")).alias("upper"), F.greatest(F.lit(0.0), F.col("tpr") - F.col("sd")).alias("lower"))


def group_accuracy(df: DataFrame, by: list[str], label: str = "label", p: str = "probability") -> DataFrame:
    """Adds the share of a group's rows whose rounded probability is the label; a group with two labels is an error."""
    g = df.groupBy(*by).agg(F.avg((rounded(F.col(p)) == F.col(label)).cast("int")).alias("group_accuracy"), F.min(label).alias("_a"), F.max(label).alias("_b"))
    g = g.withColumn("group_accuracy", F.when(F.col("_a") == F.col("_b"), F.col("group_accuracy")).otherwise(F.raise_error(F.lit("a group has more than one label")).cast("double"))).drop("_a", "_b")
    return df.join(g, by)


def draw_rollup(df: DataFrame, key: str = "sample_id", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """By sample over posterior draws: accuracy and its binomial deviation, mean and deviation of the predictions."""
    a = F.avg((F.col(prediction) == F.col(label)).cast("int"))
    s = df.groupBy(key, label).agg(a.alias("accuracy"), F.avg(prediction).alias("avg_prediction"), F.stddev_pop(prediction).alias("prediction_std"), F.count("*").alias("draw_count"))
    return s.withColumn("accuracy_std", F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("draw_count")))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share): rows of each class, and their share of all."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_total")))).select(label, "n", (F.col("n") / F.col("_total")).alias("share"))


def mean_probability(df: DataFrame, by: list[str], p: str = "y_pred", key: str = "sample_id") -> DataFrame:
    """(by, probability, n): mean prediction and how many distinct samples it is of."""
    return df.groupBy(*by).agg(F.avg(p).alias("probability"), F.count_distinct(key).alias("n"))


def described(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """One row: n, mean, std, low, q1, q2, q3, high of the known values; quartiles in between values, or approximate ones."""
    shares, names = [0.25, 0.5, 0.75], ("q1", "q2", "q3")
    x = F.col(value)
    rest = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), *([] if exact else [F.percentile_approx(x, shares).alias("_q")]))
    if exact:
        rest = rest.crossJoin(F.broadcast(quantiles(df, value, shares).agg(F.first("quantiles").alias("_q"))))
    return rest.select("n", "mean", "std", "low", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(names)], "high")
