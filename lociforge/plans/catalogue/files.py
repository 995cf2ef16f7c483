"""Scans: JSON columns, pushed-down filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.plans.catalogue import Tables, query
from lociforge.sources.readers import select_samples


@query("SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def split_json_artifact(t: Tables) -> DataFrame:
    parsed = t.events.select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 5, 7, 64, 99)")
def sample_scan_by_list(t: Tables) -> DataFrame:
    """A short id list, pushed down to the scan."""
    return select_samples(t.lineitem, [1, 5, 7, 64, 99], ["l_quantity"], "l_orderkey")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sample_scan_by_table(t: Tables) -> DataFrame:
    """A long id list: a semi join."""
    ids = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return select_samples(t.lineitem, ids, ["l_quantity"], "l_orderkey")
