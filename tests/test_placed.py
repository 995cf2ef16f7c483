"""Places in ranges, and the random gene sets that share a size."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.functions import series as N
from lociforge.operators import cohort as C
from lociforge.operators import expression as X


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_places(spark, by):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.integers(0, 20)), None if k % 11 == 0 else "ab"[int(k % 9 == 0)], int(k % 2)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, v double, g string, h int").repartition(5)
    got = {r.id: r.n for r in N.placed(df, "n", [F.desc("v"), F.asc("id")], by).collect()}
    groups = defaultdict(list)
    for k, v, g, h in rows:
        groups[{(): 0, ("g",): g, ("g", "h"): (g, h)}[by]].append((-v, k))
    assert got == {k: i for x in groups.values() for i, (_, k) in enumerate(sorted(x), 1)}
    assert N.placed(df.limit(0), "n", [F.col("id")], by).count() == 0


def test_no_window_holds_a_whole_group(spark):
    """Windows have a part of the order among their keys, or run over one row for each part."""
    df = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(0).alias("draw_count"), F.lit("x").alias("stratum"), F.lit(0.5).alias("y_pred"))
    for out in (C.balance(df), C.bootstrap(df, 50, 1), C.permuted_labels(df, 1), X.permutation_null(df, 3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line:
                assert "_part" in line or "sum(_c" in line, line


def score(w, places):
    inside, hit, best, n, k = set(places), 0.0, [0.0, 0.0], len(w), len(places)
    total = sum(w[p - 1] for p in places)
    miss = 0
    for r in range(1, n + 1):
        before = hit / total - miss / (n - k)
        if r in inside:
            best[1] = min(best[1], before)
            hit += w[r - 1]
            best[0] = max(best[0], hit / total - miss / (n - k))
        else:
            miss += 1
    up, down = best
    return up, down


def random_set(n, size, run, seed):
    numbers = math.ceil(-n * math.log(1 - size / (n + 1)) + 8 * math.sqrt(size) + 20)
    seen = dict.fromkeys(int(hashlib.md5(f"{size}#{run}#{k}#{seed}".encode()).hexdigest()[:12], 16) % n + 1 for k in range(1, numbers + 1))
    assert len(seen) >= size
    return sorted(list(seen)[:size])


def test_p_values_against_plain_python(spark):
    rng = np.random.default_rng(2)
    n, runs = 60, 40
    scores = np.sort(rng.normal(0.3, 1, n))[::-1]
    ranked = spark.createDataFrame([(f"g{k:02d}", float(v)) for k, v in enumerate(scores)], "gene string, score double").repartition(4)
    sets = [("top", [f"g{k:02d}" for k in range(6)]), ("low", [f"g{k:02d}" for k in range(52, 58)]), ("mid", [f"g{k:02d}" for k in range(5, 50, 4)]), ("tiny", ["g00"]), ("all", [f"g{k:02d}" for k in range(n)]), ("six", [f"g{k:02d}" for k in range(0, 60, 10)] + ["none"])]
    got = {r.set: r for r in X.enrichment_p_values(ranked, spark.createDataFrame(sets, "set string, genes array<string>"), permutations=runs).collect()}
    assert set(got) == {"top", "low", "mid", "six"}
    w = np.abs(scores)
    pick = lambda p: p[0] if abs(p[0]) >= abs(p[1]) else p[1]
    for name, genes in sets:
        if name not in got:
            continue
        places = sorted(int(g[1:]) + 1 for g in genes if g != "none")
        es = pick(score(w, places))
        null = [pick(score(w, random_set(n, len(places), run, 42))) for run in range(1, runs + 1)]
        same = [e for e in null if (e >= 0) == (es >= 0)]
        assert got[name].es == pytest.approx(es) and got[name].size == len(places)
        assert got[name].p == pytest.approx(np.mean([abs(e) >= abs(es) for e in same]) if same else 1.0)
        assert got[name].nes == (pytest.approx(es / np.mean(np.abs(same))) if same else None)
    assert got["top"].p < 0.1


def test_sets_of_one_size_share_their_random_sets(spark):
    ranks = N.placed(spark.range(30).select(F.col("id").alias("_g"), (F.col("id") + 1.0).alias("_w")), "_r", [F.col("_g")])
    sizes = spark.createDataFrame([(3,), (3,), (5,), (40,), (None,)], "size long")
    got = X.null_scores(ranks, sizes, 7, 1).collect()
    assert sorted({r.size for r in got}) == [3, 5] and len(got) == 14
