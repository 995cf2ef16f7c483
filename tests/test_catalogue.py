"""Every registered query with an SQL twin gives the same rows in DuckDB."""

import duckdb
import pytest

from lociforge.plans import catalogue

catalogue.load()
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return [normal(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(str([normal(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(str([normal(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs


def test_pushed_down_filter(spark):
    plan = catalogue.QUERIES["sample_scan_by_list"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(l_orderkey" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_interval_join_has_equi_keys(spark):
    plan = catalogue.QUERIES["interval_semi_join"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
