"""Summaries of runs: means, and the three ways in which deviations are combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that model summaries report (fixed values).
MODEL_METRICS = ("f1", "case_accuracy", "control_accuracy", "mcc", "roc_auc", "pr_auc")


def rms(std: Column) -> Column:
    """Root of the mean square: deviations of equally weighted parts."""
    return F.sqrt(F.avg(std * std))


def root_of_sum(variance: Column) -> Column:
    """Deviation of a sum of independent parts."""
    return F.sqrt(F.sum(variance))


def mean_std(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation; rows with a null key are left out."""
    known = df.dropna(subset=by)
    return known.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def wide(df: DataFrame, by: list[str], names: list[str], name: str = "metric", values: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """One column {name}_{value} for each name and value. The names are given, so no job finds them and the schema is fixed."""
    cells = [F.max(F.when(F.col(name) == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values]
    return df.groupBy(*by).agg(*cells)


def model_metrics(long: DataFrame, names: list[str], by: tuple[str, ...] = ("model_name", "dataset")) -> DataFrame:
    """Mean and deviation of each metric by model and dataset (or table)."""
    wanted = long.where(F.col("metric").isin(names))
    return wide(mean_std(wanted, [*by, "metric"]), list(by), names)


def sample_metrics(long: DataFrame, models: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, ...] = ("sample_id", "label")) -> DataFrame:
    """For each sample a column {metric}_{model} with the mean, and one with the deviation ({…}_std), for the listed pairs."""
    named = long.join(models, "run_id", "left")
    grouped = mean_std(named, [*keys, "model_name", "metric"])
    here = lambda m, n: (F.col("metric") == m) & (F.col("model_name") == n)
    cells = [c for m, n in sorted(pairs) for c in (F.max(F.when(here(m, n), F.col("mean"))).alias(f"{m}_{n}"), F.max(F.when(here(m, n), F.col("std"))).alias(f"{m}_{n}_std"))]
    return grouped.groupBy(*keys).agg(*cells)


def feature_importance(df: DataFrame, value: str = "importance", by: tuple[str, ...] = ("model_name", "feature_name")) -> DataFrame:
    """Mean and deviation of importances by model and feature."""
    return df.groupBy(*by).agg(F.avg(value).alias("importance_mean"), F.stddev_samp(value).alias("importance_std"))


def class_importances(df: DataFrame, value: str = "importance", by: tuple[str, ...] = ("model_name", "feature_name")) -> DataFrame:
    """Mean and deviation of importances, and of every class_... column, by model and feature; a class column without values gives nulls."""
    names = {value: "importance", **{c: c for c in df.columns if c.startswith("class_")}}
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{k}") for c, n in names.items() for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def outer_importances(df: DataFrame, by: tuple[str, ...] = ("model_name", "feature_name")) -> DataFrame:
    """Over outer iterations: means of all ..._mean columns, root mean squares of the ..._std columns beside them."""
    names = [c[:-5] for c in df.columns if c.endswith("_mean") and f"{c[:-5]}_std" in df.columns]
    return df.groupBy(*by).agg(*[x for n in names for x in (F.avg(f"{n}_mean").alias(f"{n}_mean"), rms(F.col(f"{n}_std")).alias(f"{n}_std"))])


def base_metric(column: str) -> str:
    """What a column of sample metrics is about: its name before the first _ (log_loss is about log)."""
    return column.split("_")[0]


def overall_metrics(df: DataFrame, kept: tuple[str, ...] = ("sample_id", "label", "run_id", "total_draw_count")) -> DataFrame:
    """Adds, for each base metric that has columns of several models and none of its own, the row's mean over these."""
    from lociforge.functions.frames import row_mean

    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c not in kept and not c.endswith("_std"):
            groups.setdefault(base_metric(c), []).append(c)
    return df.withColumns({b: row_mean(*cs) for b, cs in groups.items() if len(cs) > 1 and b not in df.columns})


def all_models(by_model: DataFrame, feature: str = "feature_name") -> DataFrame:
    """Importances over all models: mean of means, root mean square of deviations, both divided by the sum of the means.

    If that sum is not positive there is no summary: the result is empty. The sum is one row, joined to all.
    """
    joint = by_model.groupBy(feature).agg(F.avg("importance_mean").alias("m"), rms(F.col("importance_std")).alias("s"))
    total = joint.agg(F.sum("m").alias("total"))
    return joint.crossJoin(F.broadcast(total)).where("total > 0").select(feature, (F.col("m") / F.col("total")).alias("importance_mean"), (F.col("s") / F.col("total")).alias("importance_std"))


def pooled(df: DataFrame, mean: str = "accuracy", variance: str = "variance", weight: str = "draw_count") -> DataFrame:
    """Weighted mean and pooled deviation: sum of n (variance + (mean - overall)^2) over the sum of n. One pass.

    sum n (m - M)^2 = sum n m^2 - N M^2, with partial sums taken about no shift; means are expected near 0 to 1.
    """
    n, m, v = F.col(weight), F.col(mean), F.col(variance)
    s = df.agg(F.sum(n).alias("n"), F.sum(n * m).alias("nm"), F.sum(n * m * m).alias("nmm"), F.sum(n * v).alias("nv"))
    overall = F.col("nm") / F.col("n")
    spread = F.greatest(F.col("nmm") / F.col("n") - overall * overall, F.lit(0.0))
    return s.where("n > 0").select(overall.alias("weighted_mean_accuracy"), F.sqrt(F.col("nv") / F.col("n") + spread).alias("accuracy_std"), F.col("n").alias("total_draw_count"))


def validation_rollup(df: DataFrame, keys: tuple[str, ...] = ("sample_id", "label")) -> DataFrame:
    """By sample: mean accuracy and prediction, roots of summed variances, all draws."""
    means = df.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.avg("prediction").alias("prediction"))
    sums = df.groupBy(keys[0]).agg(root_of_sum(F.col("variance_accuracy")).alias("accuracy_std"), root_of_sum(F.col("variance_prediction")).alias("prediction_std"), F.sum("draw_count").alias("total_draw_count"))
    return means.join(sums, keys[0], "left")


def outer_metrics(df: DataFrame, names: list[str], by: tuple[str, ...] = ("outer_iteration", "model_name", "dataset")) -> DataFrame:
    """Mean of means and root mean square of deviations; leave outer_iteration out of `by` to pool the iterations."""
    cells = [c for n in names for c in (F.avg(f"{n}_mean").alias(f"{n}_mean"), rms(F.col(f"{n}_std")).alias(f"{n}_std"))]
    return df.groupBy(*by).agg(*cells)


def outer_sample_metrics(df: DataFrame, means: list[str], kept: tuple[str, ...] = ("label",), key: str = "sample_id", order: str = "run_id", count: str = "total_draw_count") -> DataFrame:
    """By sample over outer iterations: kept columns of the first run, summed draws, means, and deviations.

    A metric that has a {name}_std column gets its root mean square, another the sample deviation of its means.
    """
    cells = [F.min_by(c, order).alias(c) for c in kept]
    if count in df.columns:
        cells.append(F.sum(count).alias(count))
    for m in means:
        std = rms(F.col(f"{m}_std")) if f"{m}_std" in df.columns else F.stddev_samp(m)
        cells += [F.avg(m).alias(m), std.alias(f"{m}_std")]
    return df.groupBy(key).agg(*cells)


def consensus(selected: DataFrame, iteration: str = "iteration", feature: str = "feature_name", least: int = 2) -> DataFrame:
    """Features that at least so many iterations selected, with their votes, in the order in which they were first seen."""
    votes = selected.groupBy(feature).agg(F.count("*").alias("votes"), F.min(iteration).alias("first_seen"))
    return votes.where(F.col("votes") >= least)


def complete_runs(runs: DataFrame, artifacts: DataFrame, required: list[str]) -> DataFrame:
    """Runs that have metrics and every required artifact."""
    have = artifacts.where(F.col("artifact").isin(required)).groupBy("run_id").agg(F.count_distinct("artifact").alias("n")).where(F.col("n") == len(required))
    return runs.where(F.size("metrics") > 0).join(have, "run_id", "left_semi")


def melted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long rows (keys, name, value): one for each metric column, nulls kept."""
    return df.select(*keys, *metrics).unpivot(keys, metrics, "name", "value")


def metric_maps(long: DataFrame, run: str = "run_id", key: str = "key", value: str = "value") -> DataFrame:
    """(run, metrics, n_metrics): each run's metrics as a map, of a repeated key the largest value, and how many rows they were."""
    entries = long.groupBy(run, key).agg(F.max(value).alias("_value"), F.count("*").alias("_n"))
    return entries.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct(key, "_value"))).alias("metrics"), F.sum("_n").alias("n_metrics"))
