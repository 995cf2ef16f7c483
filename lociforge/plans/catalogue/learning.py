"""Classifiers and posterior feature selection."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators import horseshoe as H
from lociforge.operators import models as M
from lociforge.operators import selection as L
from lociforge.plans.catalogue import Tables, query

_COLUMNS = ["quantity", "discount", "tax", "price"]


def samples(t: Tables) -> DataFrame:
    """Stand-in study: orders as samples, urgent ones as cases."""
    x = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("price"))
    y = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 150000).cast("int").alias("label"))
    return x.join(y, "l_orderkey").withColumnRenamed("l_orderkey", "sample_id")


def vectors(t: Tables) -> DataFrame:
    return VectorAssembler(inputCols=_COLUMNS, outputCol="features").transform(samples(t)).select("sample_id", "label", "features")


def _fitted(t: Tables, name: str, lift: bool = False) -> DataFrame:
    v = vectors(t)
    if lift:
        from pyspark.ml.feature import MinMaxScaler

        scaled = MinMaxScaler(inputCol="features", outputCol="s").fit(v).transform(v)
        v = M.fourier_features(scaled.select("sample_id", "label", F.col("s").alias("features")))
    train, test = v.where("sample_id % 4 <> 0"), v.where("sample_id % 4 = 0")
    return M.predict(M.fit(train, name, scale=not lift), test).select("sample_id", "label", "y_pred")


@query()
def lr_elasticnet(t: Tables) -> DataFrame:
    return _fitted(t, "elastic_net")


@query()
def naive_bayes(t: Tables) -> DataFrame:
    return _fitted(t, "naive_bayes")


@query()
def linear_svc(t: Tables) -> DataFrame:
    return _fitted(t, "linear_svc")


@query()
def gbt(t: Tables) -> DataFrame:
    return _fitted(t, "gradient_boosting")


@query()
def random_forest(t: Tables) -> DataFrame:
    return _fitted(t, "random_forest")


@query()
def mlp(t: Tables) -> DataFrame:
    return _fitted(t, "mlp")


@query()
def rff_svc(t: Tables) -> DataFrame:
    """A kernel classifier, approximated by random features."""
    return _fitted(t, "elastic_net", lift=True)


@query()
def horseshoe_selector(t: Tables) -> DataFrame:
    """Posterior effects of each feature over five iterations, among which all samples are dealt out."""
    s = samples(t).withColumn("iteration", (F.col("sample_id") % 5).cast("int"))
    return L.effect_sizes(H.bayesian_selector(s, _COLUMNS))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 20 <> 0),
  d AS (SELECT q.vec_id, b.label, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2)), 6) AS d, b.vec_id AS n FROM q, b),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, n) AS r FROM d)
  SELECT vec_id, round(avg(CASE WHEN label < 5 THEN 1 ELSE 0 END), 6) AS p1 FROM r WHERE r <= 5 GROUP BY 1""")
def knn_classify(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("y", (F.col("label") < 5).cast("double"))
    return M.knn(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), 5, "embedding", "vec_id", "y").select("vec_id", F.round("p1", 6).alias("p1"))
