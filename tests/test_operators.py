"""Hand-sized fixtures with known answers."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lociforge.functions import genotype as G
from lociforge.functions import series as N
from lociforge.functions import text as X
from lociforge.functions.predicates import filtered
from lociforge.operators import horseshoe as H
from lociforge.operators import cohort as C
from lociforge.operators import intervals as I
from lociforge.operators import metrics as M
from lociforge.operators import models as L
from lociforge.operators import selection as S
from lociforge.operators import summaries as R
from lociforge.operators import variants as V


def test_genotype_coding(spark):
    df = spark.createDataFrame([(c,) for c in ("0/0", "0/1", "1/2", "2/2", "./.")], "g string")
    got = df.select(G.zygosity(F.col("g")), G.binarised(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (1, 1), (2, 1), (None, None)]


def test_variant_stats(spark):
    df = spark.createDataFrame([("1", 1, s, g) for s, g in enumerate((0, 1, 2, 1))] + [("1", 2, s, g) for s, g in enumerate((0, None, 2))], "contig string, pos int, sample_id int, gt int")
    r = {x.pos: x for x in V.variant_stats(df).collect()}
    assert r[1].maf == 0.5 and abs(r[1].stdev - 0.70711) < 1e-5 and not r[1].has_missing and r[2].has_missing
    assert [x.pos for x in V.qc_variants(df).collect()] == [1]


def test_contigs(spark):
    df = spark.createDataFrame([(c,) for c in ("chr1", "22", "23", "chrX", "MT", "M", "chr1_alt")], "c string")
    assert [r.c for r in df.where(F.col("c").rlike(G.CONTIG_PATTERN)).collect()] == ["chr1", "22", "chrX", "M", "chr1_alt"]


def test_interval_ends(spark):
    points = spark.createDataFrame([("1", p) for p in (99, 100, 200, 201)], "contig string, pos int")
    genes = spark.createDataFrame([("1", 100, 200), ("1", 150, 300)], "contig string, start_pos int, end_pos int").limit(1)
    assert sorted(r.pos for r in I.interval_semi_join(points, genes, width=64).collect()) == [100, 200]


def test_attributes_and_metric_paths(spark):
    df = spark.createDataFrame([('gene_id "G1"; level 2; gene_name "A";',)], "a string")
    assert tuple(df.select(*[X.attribute(F.col("a"), k) for k in ("gene_id", "level", "gene_name", "none")]).first()) == ("G1", None, "A", None)
    keys = spark.createDataFrame([(k,) for k in ("test/f1", "holdout/T/f1", "test/g/m", "holdout/T/g/m", "x")], "k string")
    got = [r.p and tuple(r.p) for r in keys.select(X.metric_path(F.col("k")).alias("p")).collect()]
    assert got == [("test", None, "f1"), ("holdout", "T", "f1"), ("test", None, "m"), ("holdout", "T", "m"), None]


def test_deviations(spark):
    df = spark.createDataFrame([(0.8, 10, 0.01), (0.6, 30, 0.02)], "accuracy double, draw_count long, variance double")
    r = R.pooled(df).first()
    assert abs(r.weighted_mean_accuracy - 0.65) < 1e-12 and abs(r.accuracy_std - 0.158114) < 1e-6
    d = spark.createDataFrame([(3.0, 0.09), (4.0, 0.16)], "s double, v double")
    assert np.allclose(tuple(d.select(R.rms(F.col("s")), R.root_of_sum(F.col("v"))).first()), (3.535534, 0.5))


def test_consensus(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c")], "iteration int, feature_name string")
    assert [r.feature_name for r in R.consensus(df).orderBy("first_seen", "feature_name").collect()] == ["b", "c"]


def test_classifier_metrics(spark):
    rows = [(1, 0.9)] * 3 + [(0, 0.1)] * 4 + [(0, 0.9)] + [(1, 0.1)] * 2
    r = M.classifier_metrics(spark.createDataFrame(rows, "label int, y_pred double")).first()
    assert np.allclose([r.f1, r.mcc, r.case_accuracy, r.control_accuracy, r.balanced_accuracy], [0.666667, 0.408248, 0.6, 0.8, 0.7], atol=1e-6)
    empty = M.classifier_metrics(spark.createDataFrame([(0, 0.1)], "label int, y_pred double")).first()
    assert (empty.f1, empty.mcc, empty.case_accuracy) == (0.0, 0.0, 0.0)


def test_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,)], "x double").select(M.rounded(F.col("x"))).collect()] == [0, 2]


def test_quartiles_and_unknown(spark):
    df = spark.createDataFrame([(float(x), "a_", 1.0) for x in (1, 2, 4, 9)], "x double, c string, k double")
    assert [e for e in C.quartile_edges(df, ["x"]).first().x_edges] == [1.0, 1.75, 3.0, 5.25, 9.0]
    assert sorted(r.stratum for r in C.strata(df, ["k", "x", "c"]).collect()) == [f"Unknown_Q{k}_a" for k in range(1, 5)]


def test_balance(spark):
    df = spark.createDataFrame([("c1", "case", 2), ("c2", "case", 0), ("c3", "case", 1), ("k1", "control", 0), ("k2", "control", 0)], "sample_id string, label string, draw_count int")
    assert sorted((r.sample_id, r.draw_count) for r in C.balance(df).collect()) == [("c2", 1), ("c3", 2), ("k1", 1), ("k2", 1)]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    assert sorted(tuple(r) for r in C.keep_first(df, "k", F.col("n")).collect()) == [("a", 1), ("b", 2)]


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r.p: r.padj for r in N.bh_adjust(df).collect()}
    assert np.allclose([got[0.01], got[0.04], got[0.03]], [0.03, 0.04, 0.04]) and got[None] is None


def test_guards(spark):
    df = spark.createDataFrame([("case",), ("other",)], "label string")
    with pytest.raises(ValueError, match="age"):
        C.check_columns(df, ["label", "age"])
    with pytest.raises(Exception, match="label may not be other"):
        C.check_values(df, "label", ["case", "control"]).collect()


def test_predicates(spark):
    df = spark.createDataFrame([("x & y", 1), ("b", 5)], "`Subject Group` string, n int")
    assert filtered(df, "`Subject Group` == 'x & y' & n >= 1").count() == 1
    assert filtered(df, "n > 1 | `Subject Group` != 'b'").count() == 2
    assert filtered(df, None).count() == 2


def test_curves_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, y_pred double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(M.roc_auc(df).first().auc - np.mean(pairs)) < 1e-9


def test_tail_threshold_steps(spark):
    x = np.linspace(0, 10, 201)
    d = np.exp(-x)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, d))], "k int, x double, density double")
    assert 2.0 < S.tail_threshold(df, tail=0.1, sensitivity=1e-9).first().threshold < 2.6


def test_stack_and_knn(spark):
    rng = np.random.default_rng(1)
    x = rng.random((120, 3))
    rows = [(k, int(v[0] > 0.5), Vectors.dense(v.tolist()), v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "label", "features", "e"])
    model = L.fit(df, "elastic_net")
    assert L.predict(model, df).where("(y_pred > 0.5) = (label = 1)").count() > 100
    assert L.importances(model, ["a", "b", "c"])[0][0] == "a"
    near = L.knn(df.where("id >= 20"), df.where("id < 20"), 5, "e", "id", "label")
    d = ((x[:20, None] - x[None, 20:]) ** 2).sum(2).argsort(1)[:, :5] + 20
    want = {k: np.mean([x[j, 0] > 0.5 for j in d[k]]) for k in range(20)}
    assert {r.id: r.p1 for r in near.collect()} == pytest.approx(want)
    assert L.knn(df.where("id >= 20"), df.where("id < 20"), 5, "e", "id", "label", block=7).count() == 20


def test_selector_prefers_the_real_feature(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    df = spark.createDataFrame([(0, int(v[1] > 0.5), *map(float, v)) for v in x], "iteration int, label int, f0 double, f1 double, f2 double, f3 double")
    e = S.effect_sizes(H.bayesian_selector(df, ["f0", "f1", "f2", "f3"])).orderBy(F.desc("effect_size")).first()
    assert e.feature_name == "f1"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.booleans()), min_size=1, max_size=30))
def test_split_is_disjoint_and_balanced(spark, rows):
    df = spark.createDataFrame([(k, s, "case" if c else "control", 0) for k, (s, c) in enumerate(rows)], "sample_id int, stratum string, label string, draw_count int")
    got = C.stratified_split(df, 0.3, 1).collect()
    assert sorted(r.sample_id for r in got) == list(range(len(rows)))
    for s in "ab":
        n = sum(x == s for x, _ in rows)
        assert sum(r.part == "test" for r in got if r.stratum == s) == math.floor(n * 0.3 + 0.5)
    sizes = {r.label: r["count"] for r in C.balance(df).groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1


def test_permutation_keeps_labels(spark):
    df = spark.createDataFrame([(k, k % 3, k % 2) for k in range(50)], "sample_id int, label int, g int")
    got = C.permuted_labels(df, 4, group="g").collect()
    for g in (0, 1):
        assert sorted(r.permuted for r in got if r.g == g) == sorted(r.label for r in got if r.g == g)
    assert any(r.permuted != r.label for r in got)
