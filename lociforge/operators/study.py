"""Composed steps of a study: from calls to features, from features to scored models, from runs to summaries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.genotype import is_snp, variant_id
from lociforge.operators import cohort as C
from lociforge.operators import metrics as S
from lociforge.operators import models as M
from lociforge.operators import summaries as R
from lociforge.operators.intervals import interval_semi_join
from lociforge.operators.variants import qc_condition, variant_stats
from lociforge.sources.shared import exists, new_path


def genotype_features(calls: DataFrame, genes: DataFrame | None = None, gene_set: DataFrame | None = None, gt: str = "gt", copies: int = 2, **limits) -> DataFrame:
    """Long features (sample_id, variant_id, gt) of calls (contig, pos, alleles, sample_id, gt): single-base variants that pass
    the quality filter and lie in one of the genes (contig, start_pos, end_pos, gene_name), of the gene set (gene_name) if given.
    """
    if gene_set is not None:
        genes = genes.join(gene_set.select("gene_name").distinct(), "gene_name", "left_semi")
    if genes is not None:
        calls = interval_semi_join(calls, genes)
    snps = calls.where(is_snp(F.col("alleles")))
    kept = variant_stats(snps, gt, copies).where(qc_condition(**limits)).select("contig", "pos")
    return snps.join(kept, ["contig", "pos"], "left_semi").select("sample_id", variant_id(F.col("contig"), F.col("pos")).alias("variant_id"), F.col(gt).alias("gt"))


def prepare(features: DataFrame, train: DataFrame, test: DataFrame, columns: list[str] | None = None, key: str = "sample_id", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows of the samples in train and test (key, label) with the chosen feature columns; a sample without features is an error when read."""
    chosen = columns if columns is not None else [c for c in features.columns if c not in (key, label)]
    wide = features.select(key, *chosen, F.lit(True).alias("_there"))

    def side(ids: DataFrame) -> DataFrame:
        lacks = F.raise_error(F.concat(F.lit("no features of sample "), F.col(key).cast("string")))
        return ids.select(key, label).join(wide, key, "left").withColumn(label, F.when(F.col("_there"), F.col(label)).otherwise(lacks)).drop("_there")

    return side(train), side(test)


def evaluate(train: DataFrame, test: DataFrame, name: str, holdouts: dict[str, DataFrame] | None = None, columns: list[str] | None = None) -> dict[str, DataFrame | Model | None]:
    """Fits a model of the stack on train (sample_id, label, features) and scores train, test and each holdout table.

    Gives the model; predictions (dataset, table, sample_id, label, y_pred, brier, log_loss, accuracy); metrics (dataset,
    table, counts, F1, MCC, accuracies); importances (feature_name, importance), None for a model that has none. The curves'
    areas, which sort scores, are S.roc_auc and S.average_precision of the predictions.
    """
    fitted = M.fit(train, name)
    parts = [("train", None, train), ("test", None, test), *(("holdout", k, df) for k, df in (holdouts or {}).items())]
    scored = None
    for dataset, table, df in parts:
        one = S.sample_scores(M.predict(fitted, df)).select(F.lit(dataset).alias("dataset"), F.lit(table).cast("string").alias("table"), "sample_id", "label", "y_pred", "brier", "log_loss", "accuracy")
        scored = one if scored is None else scored.unionByName(one)
    width = len(train.select("features").first().features)
    found = M.importances(fitted, columns or [str(k) for k in range(width)])
    table = None if found is None else train.sparkSession.createDataFrame(found, "feature_name string, importance double")
    return {"model": fitted, "predictions": scored, "metrics": S.classifier_metrics(scored, ("dataset", "table")), "importances": table}


FITS = "iteration int, model_name string"


def finished_fits(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of bootstrap_models at path: (iteration, model_name) of the fits whose results are written."""
    found = exists(spark, f"{path}/finished")
    return spark.read.schema(f"at string, {FITS}").parquet(f"{path}/finished").select("iteration", "model_name") if found else spark.createDataFrame([], FITS)


def bootstrap_models(samples: DataFrame, names: list[str], iterations: int, size: int, test_size: float = 0.3, seed: int = 42, holdouts: dict[str, DataFrame] | None = None, path: str | None = None, first: int = 0, parallel: int = 2) -> DataFrame:
    """Metrics (iteration, model_name, dataset, table, ...) of each model on bootstrapped splits of samples (sample_id, label, features).

    Each iteration from `first` on splits by label, draws its training rows with replacement within labels, and leaves the test
    rows as they are. What a fit gives is written to path, then the fit is entered in a ledger there; fits in the ledger are
    not made again, so that a run that was stopped goes on where it was. Without a path a new one in the shared folder is
    taken. `parallel` iterations run at a time, each in a scheduler pool of its own. Half-written results are neither
    read nor kept. Results of one path belong to the same samples and parameters, which is not checked.
    """
    spark = samples.sparkSession
    path = path or new_path(spark)
    grid = spark.range(first, iterations).select(F.col("id").cast("int").alias("iteration"), F.explode(F.array(*map(F.lit, names))).alias("model_name"))
    todo: dict[int, list[str]] = {}
    for r in grid.join(finished_fits(spark, path), ["iteration", "model_name"], "left_anti").collect():
        todo.setdefault(r.iteration, []).append(r.model_name)

    failed = Event()

    def iterate(k: int) -> None:
        if failed.is_set():
            return
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"iteration-{k}")
        split = C.stratified_split(samples, test_size, f"{seed}#{k}", stratum="label")
        train = C.bootstrap(split.where("part = 'train'"), size, f"{seed}#{k}", stratum="label").select("sample_id", "label", "features").persist()
        test = split.where("part = 'test'").select("sample_id", "label", "features")
        try:
            for name in sorted(todo[k], key=names.index):
                if failed.is_set():
                    return
                metrics = evaluate(train, test, name, holdouts)["metrics"]
                metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics/iteration={k}/model_name={name}")
                spark.range(1).select(F.current_timestamp().cast("string").alias("at")).write.mode("overwrite").parquet(f"{path}/finished/iteration={k}/model_name={name}")
        except BaseException:
            failed.set()  # what has not begun is left out
            raise
        finally:
            train.unpersist()

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for fit in [pool.submit(inheritable_thread_target(spark)(iterate), k) for k in sorted(todo)]:
            fit.result()
    if not exists(spark, f"{path}/metrics"):
        raise ValueError("no fits: no iterations or no models")
    return spark.read.option("basePath", f"{path}/metrics").parquet(f"{path}/metrics").join(finished_fits(spark, path), ["iteration", "model_name"], "left_semi")


def threshold_summary(selectors: DataFrame, default: float, threshold: str = "threshold") -> DataFrame:
    """One row (mean, std, n) of the thresholds that selectors chose, population deviation; without any, the default and no deviation."""
    t = selectors.agg(F.avg(threshold).alias("mean"), F.stddev_pop(threshold).alias("std"), F.count(threshold).alias("n"))
    return t.select(F.coalesce("mean", F.lit(default)).alias("mean"), "std", "n")


def selected_by_vote(effects: DataFrame, most: int = 200, least: int = 2, iteration: str = "iteration") -> DataFrame:
    """Features that at least so many iterations select: in each those whose effect reaches its threshold, `most` at most.

    effects: (iteration, feature_name, effect_size, threshold).
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(iteration).orderBy(F.desc("effect_size"), "feature_name"))
    chosen = effects.where("effect_size >= threshold").withColumn("_n", rank).where(F.col("_n") <= most)
    return R.consensus(chosen, iteration, least=least)


def explanation_frame(df: DataFrame, values: str, names: list[str], key: str = "id") -> DataFrame:
    """A column for each feature from a column of explanation vectors, an array or an ML vector."""
    kind = dict(df.dtypes)[values]
    array = vector_to_array(values) if kind == "vector" else F.col(values)
    return df.select(key, *[F.get(array, F.lit(k)).alias(n) for k, n in enumerate(names)])


def summarize_all(long: DataFrame, samples: DataFrame | None, importances: DataFrame | None, models: DataFrame, metrics: list[str] = list(R.MODEL_METRICS), model_names: list[str] | None = None) -> dict[str, DataFrame]:
    """All summaries of finished runs by name: model_metrics, holdout_table_metrics, sample_metrics, feature_importances, all_models.

    long: (run_id, dataset, table, metric, value); samples: (run_id, sample_id, label, metric, value); importances: (run_id,
    feature_name, importance and class_... columns); models: (run_id, model_name). What is not given is left out.
    """
    named = long.join(models, "run_id")
    out = {"model_metrics": R.model_metrics(named, metrics)}
    out["holdout_table_metrics"] = R.model_metrics(named.where("dataset = 'holdout' and table is not null"), metrics, ("model_name", "table"))
    if samples is not None:
        names = model_names or sorted(r[0] for r in models.select("model_name").distinct().collect())
        out["sample_metrics"] = R.sample_metrics(samples, models, [(m, n) for m in ("accuracy", "log_loss") for n in names])
    if importances is not None:
        out["feature_importances"] = R.class_importances(importances.join(models, "run_id"))
        out["all_models"] = R.all_models(out["feature_importances"])
    return out
