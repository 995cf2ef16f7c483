"""Counts while rows flow, gene set filters, markers of empty summaries, tables with an index."""

import pytest
from pyspark.sql import functions as F

from lociforge.functions.frames import filter_counts, observed_filters
from lociforge.functions.predicates import holds_genes
from lociforge.sources import readers as R
from lociforge.sources import sinks as S


def test_counts_while_rows_flow(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(100)], "a int, b int").repartition(4)
    conditions = {"small": F.col("a") < 70, "third": F.col("b") == 0, "odd": F.col("a") % 2 == 1}
    kept, seen = observed_filters(df, conditions)
    kept.write.parquet(str(tmp_path / "x"))
    want = [r.n for r in filter_counts(df, conditions).orderBy("step").collect()]
    assert [seen.get[f"step_{k}"] for k in range(4)] == want
    assert spark.read.parquet(str(tmp_path / "x")).count() == want[-1]
    kept, seen = observed_filters(df.limit(0), {})
    assert kept.count() == 0 and seen.get == {"step_0": 0}


def test_gene_set_filter(spark):
    sets = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", []), ("d", None)], "set string, genes array<string>")
    chosen = lambda c: sorted(r.set for r in sets.where(c).collect())
    assert chosen(holds_genes("y")) == ["a", "b"] and chosen(holds_genes(["x", "y"], every=True)) == ["a"] and chosen(holds_genes(["x", "z"])) == ["a"]
    assert chosen(holds_genes([])) == [] and chosen(holds_genes([], every=True)) == ["a", "b", "c", "d"] and chosen(~holds_genes("y")) == ["c", "d"]


def test_empty_summaries_leave_a_marker(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    told = S.write_summaries({"model": df, "features": {"svm": df, "knn": df.limit(0)}}, str(tmp_path))
    assert {(r.name, r.n_rows) for r in told.collect()} == {("model_summary", 1), ("features_summary_svm", 1), ("features_summary_knn", 0)}
    assert spark.read.text(str(tmp_path / "features_summary_knn_empty.txt")).first().value == "features_summary_knn is empty."
    assert not (tmp_path / "features_summary_knn.csv").exists()


def test_index_of_two_columns(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("s1\tchrom\ts2\tposition\n0\t1\t2\t500\n1\t\t1\t7\n2\tX\t0\t9\n")
    df = R.read_table(spark, str(tmp_path / "g.tsv"), index=["chrom", "position"])
    assert df.columns == ["chrom", "position", "s1", "s2"] and sorted(tuple(r) for r in df.collect()) == [("1", 500, 0, 2), ("X", 9, 2, 0)]
    with pytest.raises(Exception):
        R.read_table(spark, str(tmp_path / "g.tsv"), index=["none"])
