"""Intermediate tables in the folder that the cluster shares, and sizes of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if the session is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = f"file://{tempfile.mkdtemp(prefix='lociforge-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, compression: str | None = None, bucket: str | None = None) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lineage ends there, and lost executors lose nothing.

    With a bucket column, joins and groups by it read the table without a shuffle. It has as many buckets as a shuffle has partitions.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{_tables(spark)}/{name}"
    if not bucket:
        df.write.parquet(path, compression=compression)
        return spark.read.schema(df.schema).parquet(path)
    table = f"spark_catalog.default.lociforge_{name}"  # only tables of a catalog have buckets
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, bucket).option("compression", compression).saveAsTable(table, format="parquet", path=path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and out reads them
    return out


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Results that were not yet written read from them: call it after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n


def segments(n_bytes: int, each: int) -> int:
    """How many segments of a hash space give each about so many bytes: grows with the input, without a cap."""
    return max(4, -(-n_bytes // each))
