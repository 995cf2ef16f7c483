"""Values that are computed anew with other last digits, and ties of copied rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.functions import series as N
from lociforge.operators import selection as L


def unsteady(spark, n=200):
    """Values whose last digits differ each time that they are computed, as sums of doubles do in a shuffle."""
    noise = F.udf(lambda k: k * (1 + 1e-12 * random.random()), "double").asNondeterministic()
    return spark.range(1, n + 1).select(noise("id").alias("a"), noise("id").alias("b"))


def test_ranks_lose_no_rows(spark):
    assert N.spearman(unsteady(spark), "a", "b").first().rho == pytest.approx(1.0)


def test_exact_means(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(500) * 1e5, 2)
    rows = [(k, float(v)) for k in range(40) for v in rng.permutation(x)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {r.m for r in df.groupBy("k").agg(N.exact_mean("v").alias("m")).collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(x.mean(), rel=1e-14)
    assert spark.createDataFrame([(None,), (2.0,)], "v double").agg(N.exact_mean("v").alias("m")).first().m == 2.0


def test_adjusted_ties(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.02,), (0.02,), (0.5,), (None,)], "p double")
    last, first = ([r.padj for r in N.bh_adjust(df, first=f).orderBy("p").collect()] for f in (False, True))
    assert last == [None, *map(pytest.approx, [0.025, 0.025, 0.025, 0.025, 0.5])] and first == [None, *map(pytest.approx, [0.05, 0.05, 0.05, 0.05, 0.5])]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Twelve copies of the small lineitem with keys of their own, in another order each."""
    folder = str(tmp_path_factory.mktemp("copies"))
    one = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    all_ = one.crossJoin(spark.range(12).withColumnRenamed("id", "_k"))
    keys = {c: F.col(c) + F.col("_k") * 100_000 for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    all_.withColumns(keys).orderBy(F.hash("l_orderkey", "l_linenumber", "_k")).drop("_k").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_adjusted_p_of_copies(spark, copies):
    """The SQL's sums are doubles, which may part equal p; exact sums are given to it here."""
    from lociforge.plans import catalogue

    catalogue.load()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(l_discount AS DECIMAL(18, 4)) AS l_discount) FROM '{copies}/lineitem.parquet/*.parquet'")
    theirs = sorted(duck.execute(catalogue.SQL["bh_adjust"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["bh_adjust"](spark, copies).collect()) == theirs and len(theirs) == 120


def test_density_of_copies(spark, copies):
    """Twelve copies of each point: its nine neighbours are at no distance, and neither has the SQL a number."""
    from lociforge.plans import catalogue

    catalogue.load()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{copies}/lineitem.parquet/*.parquet' WHERE l_linenumber > 0 ORDER BY l_partkey, l_orderkey, l_linenumber")
    theirs = [(k, x, math.isnan(d)) for k, x, d in duck.execute(catalogue.SQL["kde_grid"]).fetchall()]
    ours = [(k, x, math.isnan(d)) for k, x, d in catalogue.QUERIES["kde_grid"](spark, copies).collect()]
    assert sorted(ours) == sorted(theirs) and len(ours) == 200 and all(no for *_, no in ours)


def test_density_of_unsteady_values(spark):
    """Each point has a place of its own, however often its value is computed."""
    got = L.adaptive_kde(unsteady(spark, 300), "a", grid=50).orderBy("k").collect()
    v = np.arange(1.0, 301.0)
    h = np.array([sorted(abs(v - x))[9] for x in v])
    x = 1 + 299 * np.arange(50) / 49
    assert np.allclose([r.density for r in got], [(np.exp(-0.5 * ((g - v) / h) ** 2) / (h * math.sqrt(2 * math.pi))).mean() for g in x])
