"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` rows of df, those with the smallest hashes of their id; which ones does not depend on the cluster.

    Ids are ranked first, so that only the chosen rows' other columns are read.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    last = df.select(key.alias("k")).orderBy("k").limit(rows).agg(F.max("k")).first()[0]
    return df.where(key <= F.lit(last) if last is not None else F.lit(False)).limit(rows)
