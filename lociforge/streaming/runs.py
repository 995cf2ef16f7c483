"""Summaries of runs while they arrive: the batch operators on a stream of (run_id, model_name, key, value, at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.text import metric_path


def stream_metrics(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, deviation and count of each metric by model, dataset and window of event time; a window closes `late` after it ends.

    State is a row for each model, dataset, metric and open window, however many events there are. Events that repeat a
    (run_id, key) inside the watermark count once.
    """
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "key"])
    known = once.withColumn("p", metric_path(F.col("key"))).where("p is not null")
    grouped = known.groupBy(F.window("at", window), "model_name", "p.dataset", "p.metric")
    return grouped.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "model_name", "dataset", "metric", "mean", "std", "n")


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes closed windows as Parquet; state and progress are kept in the checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
