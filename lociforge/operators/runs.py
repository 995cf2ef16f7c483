"""Run records: predicates over runs, metric and model sinks, artifacts of many runs as one frame."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def run_condition(ids: list[str] | str | None = None, tags: list[str] | str | None = None, types: list[str] | None = None, prefix: str | None = None, exclude: list[str] | None = None) -> Column:
    """One predicate over runs (run_name, run_type, tags map): any of the ids, and any of the tags set to 'true', and the rest.

    What is not given does not restrict; a run without a type is in no excluded type.
    """
    keep = F.lit(True)
    if ids:
        keep = keep & F.col("run_name").isin([ids] if isinstance(ids, str) else ids)
    if tags:
        keep = keep & _any([F.coalesce(F.try_element_at("tags", F.lit(t)) == "true", F.lit(False)) for t in ([tags] if isinstance(tags, str) else tags)])
    if types:
        keep = keep & F.col("run_type").isin(types)
    if prefix:
        keep = keep & F.col("run_name").startswith(prefix)
    if exclude:
        keep = keep & ~F.coalesce(F.col("run_type").isin(exclude), F.lit(False))
    return keep


def log_values(spark: SparkSession, path: str, run_id: str, metrics: dict[str, float] | None = None, params: dict | None = None, tags: dict | None = None, step: int = 0) -> None:
    """Appends a run's metrics, parameters and tags as rows (run_id, kind, key, number, text, step, at), `at` being the time of writing in nanoseconds."""
    at = time.time_ns()
    rows = [(run_id, "metric", k, float(v), None, step, at) for k, v in (metrics or {}).items()]
    rows += [(run_id, kind, k, None, str(v), step, at) for kind, d in (("param", params), ("tag", tags)) for k, v in (d or {}).items()]
    if rows:
        spark.createDataFrame(rows, "run_id string, kind string, key string, number double, text string, step long, at long").coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run: metrics, params and tags as maps. A key that was logged again has the value of its last step, of equal steps the one written last."""
    last = F.max(F.struct("step", "at", "number", "text")).alias("v")
    rows = spark.read.parquet(path).groupBy("run_id", "kind", "key").agg(last).select("run_id", "kind", "key", "v.number", "v.text")
    pairs = lambda kind, value: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", value))))
    return rows.groupBy("run_id").agg(pairs("metric", "number").alias("metrics"), pairs("param", "text").alias("params"), pairs("tag", "text").alias("tags"))


def bootstrap_iteration(params: Column) -> Column:
    """The iteration among a run's parameters, -1 if it has none."""
    return F.coalesce(F.try_element_at(params, F.lit("iteration")).try_cast("int"), F.lit(-1))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tagged_artifacts(rows: DataFrame, path: str = "path") -> DataFrame:
    """Artifact rows of all runs with dataset and table, told by the path: 'crossval' where it has test, 'holdout' where it has that.

    The table is what follows holdout in the path; rows of other artifacts are left out.
    """
    p = F.col(path)
    dataset = F.when(p.contains("holdout"), "holdout").when(p.contains("test"), "crossval")
    table = F.when(p.contains("holdout"), F.nullif(F.regexp_extract(p, "holdout/([^/]+)/", 1), F.lit("")))
    return rows.select("*", dataset.alias("dataset"), table.alias("table")).where("dataset is not null")


def known_artifacts(artifacts: DataFrame, prefix: str = "", suffix: str = ".csv") -> DataFrame:
    """Artifacts that are there (content not null), with kind: the name without prefix and suffix; other names are left out."""
    a = F.col("artifact")
    wanted = a.startswith(prefix) & a.endswith(suffix) & F.col("content").isNotNull()
    return artifacts.where(wanted).withColumn("kind", F.substr(a, F.lit(len(prefix) + 1), F.length(a) - len(prefix) - len(suffix)))
