"""Quantiles by selection, against numpy and the built-in aggregate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.operators import quantiles as Q

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_groups_of_every_shape(spark, most):
    """One group is a constant but for two rows, one spans 600 orders of magnitude, one is a single row; a key is null."""
    rng = np.random.default_rng(3)
    values = {"flat": [5.0] * 400 + [4.0, 6.0], "wide": list(10 ** rng.uniform(-300, 300, 300)), "one": [1.5], None: list(rng.integers(0, 9, 200) / 1.0), "signed": list(rng.normal(0, 1, 301))}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("flat", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.quantiles) for r in Q.quantiles(df, "v", AT, ("g",), most).collect()}
    assert set(got) == set(values)
    built_in = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, AT))).alias("q")).collect()}
    for g, x in values.items():
        assert got[g][0] == len(x)
        assert got[g][1] == pytest.approx(built_in[g], rel=1e-12)
        assert got[g][1] == pytest.approx(list(np.quantile(x, AT)), rel=1e-9)


def test_all_rows_are_one_group(spark):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("v"))
    assert Q.quantiles(df, "v", [0.5, 0.25], most=50).collect() == [(5000, [2499.5, 1249.75])]
    assert Q.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_no_key_is_larger_than_the_bound(spark):
    """Two thirds of the values are equal: they are found by their count; other ranges are parted until they are small."""
    rows = spark.range(3000).select(F.lit("0").alias("key"), F.greatest(F.col("id"), F.lit(2000)).cast("double").alias("value"))
    wanted = spark.createDataFrame([("0", 0, r, r) for r in (0, 1500, 2000, 2700, 2999)], "key string, group bigint, rank bigint, left bigint")
    found, rest, still = Q.narrowed(rows, wanted, 20)
    assert sorted((r.rank, r.value) for r in found.collect()) == [(0, 2000.0), (1500, 2000.0), (2000, 2000.0)]
    assert rest.groupBy("key").count().agg(F.max("count")).first()[0] <= 20 and still.count() == 2
    assert sorted(map(tuple, Q.selected(rows, wanted, 20).collect())) == [(0, r, float(max(r, 2000))) for r in (0, 1500, 2000, 2700, 2999)]
