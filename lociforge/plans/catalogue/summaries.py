"""Run metrics, model, sample and feature summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.text import run_type
from lociforge.operators import summaries as S
from lociforge.plans.catalogue import Tables, query
from lociforge.plans.catalogue.variants import LONG, METRICS, long_metrics, metrics

KINDS = ["click", "error", "purchase", "signup", "view"]
_R = "round(avg({0}), 6) AS {1}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _models(df: DataFrame) -> DataFrame:
    return df.withColumn("model_name", F.concat(F.lit("m"), (F.col("run_id") % 3).cast("string")))


_MODEL = "'m' || run_id % 3 AS model_name"
_CELLS = ", ".join(f"round(avg(value) FILTER (metric = '{k}'), 6) AS {k}_mean, round(stddev_samp(value) FILTER (metric = '{k}'), 6) AS {k}_std" for k in KINDS)


@query("SELECT o_orderkey, name, value FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS customer FROM orders) UNPIVOT (value FOR name IN (price, customer))")
def melt_metrics(t: Tables) -> DataFrame:
    wide = t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return S.melted(wide, ["o_orderkey"], ["price", "customer"])


@query(f"WITH {LONG} SELECT {_MODEL}, dataset, {_CELLS} FROM long GROUP BY 1, 2")
def summary_model_metrics(t: Tables) -> DataFrame:
    return _rounded(S.model_metrics(_models(long_metrics(t)), KINDS))


@query(f"WITH {LONG} SELECT {_MODEL}, tab, {_CELLS} FROM long WHERE tab IS NOT NULL GROUP BY 1, 2")
def summary_holdout_per_table(t: Tables) -> DataFrame:
    return _rounded(S.model_metrics(_models(long_metrics(t)).where("dataset = 'holdout' and tab is not null"), KINDS, ("model_name", "tab")))


_PAIRS = [(k, f"m{n}") for k in ("click", "view") for n in range(3)]
_SAMPLE_CELLS = ", ".join(f"round(avg(value) FILTER (metric = '{m}' AND model_name = '{n}'), 6) AS {m}_{n}, round(stddev_samp(value) FILTER (metric = '{m}' AND model_name = '{n}'), 6) AS {m}_{n}_std" for m, n in sorted(_PAIRS))


@query(f"WITH {LONG} SELECT sample_id, label, {_SAMPLE_CELLS} FROM (SELECT event_id % 50 AS sample_id, event_id % 2 AS label, {_MODEL}, metric, value FROM long) GROUP BY sample_id, label")
def summary_sample_metrics(t: Tables) -> DataFrame:
    long = long_metrics(t).select("run_id", (F.col("event_id") % 50).alias("sample_id"), (F.col("event_id") % 2).alias("label"), "metric", "value")
    models = _models(t.events.select(F.col("user_id").alias("run_id")).distinct())
    return _rounded(S.sample_metrics(long, models, _PAIRS))


_RUN_METRICS = "SELECT run_id, CAST(count(*) AS BIGINT) AS n_metrics, round(max(value) FILTER (key = 'train/click'), 6) AS click FROM metrics GROUP BY run_id"


@query(f"WITH {METRICS} {_RUN_METRICS}")
def run_metrics_wide(t: Tables) -> DataFrame:
    """Metric maps of runs, and one metric taken from them."""
    return S.metric_maps(metrics(t)).select("run_id", "n_metrics", F.round(F.try_element_at("metrics", F.lit("train/click")), 6).alias("click"))


IMPORTANCE = "imp AS (SELECT 'm' || l_linenumber % 3 AS model_name, l_partkey AS feature_name, l_extendedprice / 997 AS importance, l_orderkey % 4 AS outer_iteration FROM lineitem)"


def importance(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("model_name"), F.col("l_partkey").alias("feature_name"), (F.col("l_extendedprice") / 997).alias("importance"), (F.col("l_orderkey") % 4).alias("outer_iteration"))


_BY_MODEL = f"{IMPORTANCE}, by_model AS (SELECT model_name, feature_name, avg(importance) AS m, stddev_samp(importance) AS s FROM imp GROUP BY 1, 2)"


@query(f"WITH {_BY_MODEL} SELECT model_name, feature_name, round(m, 6) AS importance_mean, round(s, 6) AS importance_std FROM by_model")
def summary_feature_importance(t: Tables) -> DataFrame:
    return _rounded(S.feature_importance(importance(t)))


@query(f"WITH {_BY_MODEL}, j AS (SELECT feature_name, avg(m) AS m, sqrt(avg(s * s)) AS s FROM by_model GROUP BY 1) SELECT feature_name, round(m / (SELECT sum(m) FROM j), 9) AS importance_mean, round(s / (SELECT sum(m) FROM j), 9) AS importance_std FROM j")
def summary_feature_importance_all_models(t: Tables) -> DataFrame:
    out = S.all_models(S.feature_importance(importance(t)))
    return out.select("feature_name", F.round("importance_mean", 9).alias("importance_mean"), F.round("importance_std", 9).alias("importance_std"))


VALIDATION = """val AS (SELECT l_suppkey AS sample_id, l_suppkey % 2 AS label, l_discount * 10 AS accuracy, l_tax * 10 AS prediction, l_discount * l_tax AS variance_accuracy, l_tax / 10 AS variance_prediction, CAST(l_quantity AS BIGINT) AS draw_count FROM lineitem)"""


def validation(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        c("l_suppkey").alias("sample_id"), (c("l_suppkey") % 2).alias("label"), (c("l_discount") * 10).alias("accuracy"), (c("l_tax") * 10).alias("prediction"),
        (c("l_discount") * c("l_tax")).alias("variance_accuracy"), (c("l_tax") / 10).alias("variance_prediction"), c("l_quantity").cast("bigint").alias("draw_count"),
    )


@query(f"""WITH {VALIDATION}, w AS (SELECT sum(draw_count * accuracy) / sum(draw_count) AS mu FROM val)
  SELECT round(mu, 6) AS weighted_mean_accuracy, round(sqrt(sum(draw_count * (variance_accuracy + (accuracy - mu) ** 2)) / sum(draw_count)), 6) AS accuracy_std, CAST(sum(draw_count) AS BIGINT) AS total_draw_count FROM val, w GROUP BY mu""")
def weighted_mean_pooled_variance(t: Tables) -> DataFrame:
    return _rounded(S.pooled(validation(t), variance="variance_accuracy"))


@query(f"""WITH {VALIDATION} SELECT sample_id, label, round(avg(accuracy), 6) AS accuracy, round(avg(prediction), 6) AS prediction, round(sqrt(sum(variance_accuracy)), 6) AS accuracy_std,
  round(sqrt(sum(variance_prediction)), 6) AS prediction_std, CAST(sum(draw_count) AS BIGINT) AS total_draw_count FROM val GROUP BY 1, 2""")
def sample_validation_rollup(t: Tables) -> DataFrame:
    return _rounded(S.validation_rollup(validation(t)))


_INNER = f"""{LONG}, inner_ AS (SELECT event_id % 4 AS outer_iteration, {_MODEL}, dataset, run_id % 5 AS part, avg(value) FILTER (metric = 'click') AS click_mean, stddev_samp(value) FILTER (metric = 'click') AS click_std FROM long GROUP BY 1, 2, 3, 4)"""


def _inner(t: Tables) -> DataFrame:
    long = _models(long_metrics(t)).withColumn("outer_iteration", F.col("event_id") % 4).withColumn("part", F.col("run_id") % 5)
    return S.model_metrics(long, ["click"], ("outer_iteration", "model_name", "dataset", "part"))


@query(f"WITH {_INNER} SELECT outer_iteration, model_name, dataset, round(avg(click_mean), 6) AS click_mean, round(sqrt(avg(click_std * click_std)), 6) AS click_std FROM inner_ WHERE click_mean IS NOT NULL GROUP BY 1, 2, 3")
def outer_model_metrics(t: Tables) -> DataFrame:
    return _rounded(S.outer_metrics(_inner(t), ["click"]))


@query(f"WITH {_INNER} SELECT model_name, dataset, round(avg(click_mean), 6) AS click_mean, round(sqrt(avg(click_std * click_std)), 6) AS click_std FROM inner_ WHERE click_mean IS NOT NULL GROUP BY 1, 2")
def outer_model_metrics_pooled(t: Tables) -> DataFrame:
    return _rounded(S.outer_metrics(_inner(t), ["click"], ("model_name", "dataset")))


@query("""WITH runs AS (SELECT user_id % 40 AS sample_id, event_id % 3 AS run_id, avg(value) AS accuracy, coalesce(stddev_samp(value), 0) AS accuracy_std, max(value) AS brier, count(*) AS total_draw_count, max(event_type) AS label FROM events GROUP BY 1, 2)
  SELECT sample_id, arg_min(label, run_id) AS label, CAST(sum(total_draw_count) AS BIGINT) AS total_draw_count, round(avg(accuracy), 6) AS accuracy, round(sqrt(avg(accuracy_std * accuracy_std)), 6) AS accuracy_std, round(avg(brier), 6) AS brier, round(stddev_samp(brier), 6) AS brier_std FROM runs GROUP BY 1""")
def outer_sample_metrics(t: Tables) -> DataFrame:
    e = t.events.groupBy((F.col("user_id") % 40).alias("sample_id"), (F.col("event_id") % 3).alias("run_id"))
    runs = e.agg(F.avg("value").alias("accuracy"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("accuracy_std"), F.max("value").alias("brier"), F.count("*").alias("total_draw_count"), F.max("event_type").alias("label"))
    return _rounded(S.outer_sample_metrics(runs, ["accuracy", "brier"]))


@query(f"""WITH {IMPORTANCE}, i AS (SELECT outer_iteration, model_name, feature_name, avg(importance) AS m, coalesce(stddev_samp(importance), 0) AS s FROM imp GROUP BY 1, 2, 3)
  SELECT model_name, feature_name, round(avg(m), 6) AS importance_mean, round(sqrt(avg(s * s)), 6) AS importance_std FROM i GROUP BY 1, 2""")
def outer_feature_importance(t: Tables) -> DataFrame:
    inner = S.feature_importance(importance(t), by=("outer_iteration", "model_name", "feature_name")).fillna(0.0, ["importance_std"])
    return _rounded(S.outer_metrics(inner, ["importance"], ("model_name", "feature_name")))


@query("WITH sel AS (SELECT DISTINCT l_suppkey % 10 AS iteration, l_partkey AS feature_name FROM lineitem WHERE l_quantity > 40) SELECT feature_name, count(*) AS votes, min(iteration) AS first_seen FROM sel GROUP BY 1 HAVING count(*) > 1")
def consensus_vote(t: Tables) -> DataFrame:
    selected = t.lineitem.where("l_quantity > 40").select((F.col("l_suppkey") % 10).alias("iteration"), F.col("l_partkey").alias("feature_name")).distinct()
    return S.consensus(selected)


_NAMES = "CASE event_id % 5 WHEN 0 THEN 'Bootstrap_' || user_id WHEN 1 THEN 'Feature_Selection_' || user_id WHEN 2 THEN 'outer_bootstrap_final_summary' WHEN 3 THEN 'summary' ELSE event_type END"


@query(f"""SELECT event_id, CASE WHEN lower(n) LIKE 'bootstrap\\_%' ESCAPE '\\' THEN 'bootstrap' WHEN lower(n) LIKE 'feature\\_selection\\_%' ESCAPE '\\' THEN 'feature_selection'
  WHEN lower(n) LIKE 'outer\\_bootstrap\\_%' ESCAPE '\\' THEN 'outer_bootstrap' WHEN n = 'summary' THEN 'summary' ELSE 'model' END AS run_type FROM (SELECT event_id, {_NAMES} AS n FROM events)""")
def run_type_classify(t: Tables) -> DataFrame:
    e, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    name = F.when(e == 0, F.concat(F.lit("Bootstrap_"), u)).when(e == 1, F.concat(F.lit("Feature_Selection_"), u)).when(e == 2, "outer_bootstrap_final_summary").when(e == 3, "summary").otherwise(F.col("event_type"))
    return t.events.select("event_id", run_type(name).alias("run_type"))


@query("SELECT user_id AS run_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) = 2 AND count(*) FILTER (value > 100) > 0")
def complete_runs(t: Tables) -> DataFrame:
    runs = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.collect_list(F.when(F.col("value") > 100, F.col("value"))).alias("metrics"))
    artifacts = t.events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("artifact"))
    return S.complete_runs(runs, artifacts, ["click", "view"]).select("run_id")
