"""Intervals under the smallest bin that holds them, against all comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from lociforge.operators import intervals as I


def drawn(seed):
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 1, 40, 5000, 3_000_000, 10**12]), f"g{k}") for k in range(80) for s in [rng.randint(-50, 40_000)]]
    spans += [("a", 0, 2**62, "whole"), ("a", 300, 200, "backwards"), ("b", None, 5, "open"), (None, 1, 2, "nowhere")]
    points = [(rng.choice("abc"), rng.randint(-100, 60_000)) for _ in range(300)] + [("a", 777)] * 500 + [("a", None), (None, 1)]
    return spans, points


@pytest.mark.parametrize(("width", "reach"), [(1, 0), (16, 1), (1000, 1), (64, 500)])
def test_intervals_meet_points(spark, width, reach):
    """Half of the points are one and the same; intervals go from one base to a whole contig."""
    spans, points = drawn(width)
    i = spark.createDataFrame(spans, "contig string, start_pos bigint, end_pos bigint, gene_name string")
    p = spark.createDataFrame([(*x, k) for k, x in enumerate(points)], "contig string, pos bigint, level int")
    known = [s for s in spans if s[0] is not None and s[1] is not None and s[1] <= s[2]]
    inside = [k for k, (c, x) in enumerate(points) if x is not None and any(s[0] == c and s[1] <= x <= s[2] for s in known)]
    got = I.interval_semi_join(p, i, width)
    assert got.columns == p.columns and sorted(r.level for r in got.collect()) == inside
    names = {r.level: r.names for r in I.overlap_names(p, i, width=width, reach=reach).collect()}
    assert len(names) == len(points)
    for k, (c, x) in enumerate(points):
        over = sorted({s[3] for s in known if x is not None and s[0] == c and s[1] <= x + reach and s[2] >= x})
        assert names[k] == (",".join(over) or "N/A")


def test_an_interval_is_one_row(spark):
    i = spark.createDataFrame([("a", 5, 5 + 10**k) for k in range(15)] + [("a", 9, 3), ("a", None, 3)], "contig string, start_pos bigint, end_pos bigint")
    at = I.placed_intervals(i, 1000, "start_pos", "end_pos")
    assert at.count() == 15 and at.agg(F.max("level")).first()[0] == I.LEVELS


def test_no_intervals_and_no_points(spark):
    i = spark.createDataFrame([("a", 1, 2, "g")], "contig string, start_pos bigint, end_pos bigint, gene_name string")
    p = spark.createDataFrame([("a", 1)], "contig string, pos bigint")
    assert I.interval_semi_join(p, i.limit(0)).count() == I.interval_semi_join(p.limit(0), i).count() == I.overlap_names(p.limit(0), i).count() == 0
    assert [r.names for r in I.overlap_names(p, i.limit(0)).collect()] == ["N/A"]
