"""Writers of feature matrices, run tables, artifacts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.sources.shared import exists


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_artifact(df: DataFrame, path: str, partitions: tuple[str, ...] = ("outer_iteration", "run_id")) -> None:
    """Appends an artifact kind's rows; one table for all runs, a folder for each partition value."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, one_file: bool = False) -> None:
    """Delimited text; one_file merges the parts under one header and is meant for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def summary_name(name: str) -> str:
    """Name of a summary's files: it ends in _summary, once."""
    return name if "summary" in name else f"{name}_summary"


def write_summaries(summaries: dict[str, DataFrame | dict[str, DataFrame]], path: str) -> DataFrame:
    """Writes each summary (or each part of one, as {name}_{part}) as CSV; returns its name, rows and columns.

    One without rows is a text {name}_empty.txt instead, which says so.
    """
    out = None
    for name, value in summaries.items():
        parts = {summary_name(name): value} if isinstance(value, DataFrame) else {f"{summary_name(name)}_{k}": v for k, v in value.items()}
        for k, df in parts.items():
            if df.isEmpty():
                df.sparkSession.range(1).select(F.lit(f"{k} is empty.").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{k}_empty.txt")
            else:
                write_delimited(df, f"{path}/{k}.csv", one_file=True)
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
            out = one if out is None else out.unionByName(one)
    return out


def read_or_build(spark, path: str, build) -> DataFrame:
    """The table at path; if there is none, what build() returns, written there first."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)
