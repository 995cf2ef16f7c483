"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators import metrics as M
from lociforge.operators.quantiles import quantiles
from lociforge.plans.catalogue import Tables, query
from lociforge.plans.catalogue.summaries import _rounded

PREDS = "preds AS (SELECT doc_id AS sample_id, quality AS label, n_chars / (n_chars + 3000.0) AS y_pred, doc_id % 3 AS run_id FROM labels JOIN documents USING (doc_id))"


def preds(t: Tables) -> DataFrame:
    n = F.col("n_chars").cast("double")
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), (n / (n + 3000.0)).alias("y_pred"), (F.col("doc_id") % 3).alias("run_id"))


@query(f"WITH {PREDS} SELECT sample_id, round((label - y_pred) ** 2, 6) AS brier, round(-(label * ln(greatest(1e-15, least(1 - 1e-15, y_pred))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, y_pred)))), 6) AS log_loss, (y_pred > 0.5) = (label = 1) AS accuracy FROM preds")
def sample_scores(t: Tables) -> DataFrame:
    return _rounded(M.sample_scores(preds(t)).select("sample_id", "brier", "log_loss", "accuracy"))


CONF = f"{PREDS}, c AS (SELECT run_id, count(*) FILTER (label = 0 AND y_pred <= 0.5) AS tn, count(*) FILTER (label = 0 AND y_pred > 0.5) AS fp, count(*) FILTER (label = 1 AND y_pred <= 0.5) AS fn, count(*) FILTER (label = 1 AND y_pred > 0.5) AS tp FROM preds GROUP BY run_id)"


@query(f"""WITH {CONF}, d AS (SELECT run_id, tn, fp, fn, tp, CAST(tn AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS c, CAST(tp AS DOUBLE) AS e FROM c)
  SELECT run_id, tn, fp, fn, tp, round(coalesce(2 * e / nullif(2 * e + b + c, 0), 0), 6) AS f1, round(coalesce((e * a - b * c) / nullif(sqrt((e + b) * (e + c) * (a + b) * (a + c)), 0), 0), 6) AS mcc,
  round(coalesce(e / nullif(e + c, 0), 0), 6) AS case_accuracy, round(coalesce(a / nullif(a + b, 0), 0), 6) AS control_accuracy, round((coalesce(e / nullif(e + c, 0), 0) + coalesce(a / nullif(a + b, 0), 0)) / 2, 6) AS balanced_accuracy FROM d""")
def classifier_metrics(t: Tables) -> DataFrame:
    return _rounded(M.classifier_metrics(preds(t), ("run_id",)))


@query(f"WITH {CONF} SELECT round(sum(tn) / sum(tn + fp), 6) AS tn, round(sum(fp) / sum(tn + fp), 6) AS fp, round(sum(fn) / sum(fn + tp), 6) AS fn, round(sum(tp) / sum(fn + tp), 6) AS tp FROM c")
def confusion_row_normalised(t: Tables) -> DataFrame:
    return _rounded(M.row_normalised(M.confusion(preds(t), ("run_id",))))


@query(f"WITH {PREDS} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM preds GROUP BY label")
def class_distribution(t: Tables) -> DataFrame:
    return _rounded(M.class_distribution(preds(t)))


CUM = f"{PREDS}, s AS (SELECT y_pred AS th, sum(label) AS p, sum(1 - label) AS n FROM preds GROUP BY 1), cum AS (SELECT th, sum(p) OVER (ORDER BY th DESC) AS tps, sum(n) OVER (ORDER BY th DESC) AS fps, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM s)"


@query(f"WITH {CUM} SELECT round(th, 6) AS threshold, round(fps / nn, 6) AS fpr, round(tps / np, 6) AS tpr FROM cum")
def roc_curve(t: Tables) -> DataFrame:
    return _rounded(M.roc_curve(preds(t)))


@query(f"WITH {CUM}, r AS (SELECT fps / nn AS x, tps / np AS y, lag(fps / nn, 1, 0) OVER (ORDER BY th DESC) AS x0, lag(tps / np, 1, 0) OVER (ORDER BY th DESC) AS y0 FROM cum) SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM r")
def roc_curve_auc(t: Tables) -> DataFrame:
    return _rounded(M.roc_auc(preds(t)))


@query(f"WITH {CUM} SELECT round(th, 6) AS threshold, round(tps / (tps + fps), 6) AS precision, round(tps / np, 6) AS recall FROM cum")
def pr_curve(t: Tables) -> DataFrame:
    return _rounded(M.pr_curve(preds(t)))


@query(f"WITH {CUM}, r AS (SELECT tps / np - lag(tps / np, 1, 0) OVER (ORDER BY th DESC) AS gain, tps / (tps + fps) AS p FROM cum) SELECT round(sum(gain * p), 6) AS ap FROM r")
def pr_curve_ap(t: Tables) -> DataFrame:
    return _rounded(M.average_precision(preds(t)))


@query(f"WITH {CUM} SELECT round(avg(fps / nn), 6) AS fpr, round(avg(tps / np), 6) AS tpr, round(avg(th), 6) AS threshold FROM cum")
def curve_means(t: Tables) -> DataFrame:
    c = M.roc_curve(preds(t))
    return _rounded(c.agg(*[F.avg(x).alias(x) for x in ("fpr", "tpr", "threshold")]))


_GRID = f"""{PREDS}, s AS (SELECT run_id, y_pred AS th, sum(label) AS p, sum(1 - label) AS n FROM preds GROUP BY 1, 2),
  cum AS (SELECT run_id, sum(p) OVER (PARTITION BY run_id ORDER BY th DESC) / sum(p) OVER (PARTITION BY run_id) AS y, sum(n) OVER (PARTITION BY run_id ORDER BY th DESC) / sum(n) OVER (PARTITION BY run_id) AS x FROM s),
  pts AS (SELECT run_id, x, max(y) AS y FROM (SELECT * FROM cum UNION ALL SELECT DISTINCT run_id, 0.0, 0.0 FROM cum) GROUP BY 1, 2),
  seg AS (SELECT *, lead(x) OVER (PARTITION BY run_id ORDER BY x) AS x1, lead(y) OVER (PARTITION BY run_id ORDER BY x) AS y1 FROM pts),
  g AS (SELECT CAST(k AS BIGINT) AS k, k / 99 AS fpr FROM range(100) AS r(k)),
  v AS (SELECT k, fpr, CASE WHEN fpr = x OR x1 IS NULL THEN y ELSE y + (y1 - y) * (fpr - x) / (x1 - x) END AS y FROM g JOIN seg ON fpr >= x AND (x1 IS NULL OR fpr < x1))"""


@query(f"WITH {_GRID} SELECT round(fpr, 4) AS fpr, round(avg(y), 4) AS tpr, round(least(1, avg(y) + stddev_pop(y)), 4) AS upper, round(greatest(0, avg(y) - stddev_pop(y)), 4) AS lower FROM v GROUP BY fpr")
def mean_roc_band(t: Tables) -> DataFrame:
    return M.mean_roc(preds(t)).select(*[F.round(c, 4).alias(c) for c in ("fpr", "tpr", "upper", "lower")])


@query(f"WITH {PREDS} SELECT sample_id, round(avg(CASE WHEN round_even(y_pred, 0) = label THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, label), 6) AS group_accuracy FROM preds")
def group_accuracy(t: Tables) -> DataFrame:
    g = M.group_accuracy(preds(t).withColumn("g", F.col("label")), ["run_id", "g"], p="y_pred")
    return _rounded(g.select("sample_id", "group_accuracy"))


@query("""WITH d AS (SELECT l_suppkey AS sample_id, l_suppkey % 2 AS label, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS prediction FROM lineitem), s AS (SELECT sample_id, label, avg(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS a, avg(prediction) AS p, stddev_pop(prediction) AS sd, count(*) AS n FROM d GROUP BY 1, 2)
  SELECT sample_id, label, round(a, 6) AS accuracy, round(p, 6) AS avg_prediction, round(sd, 6) AS prediction_std, n AS draw_count, round(sqrt(a * (1 - a) / n), 6) AS accuracy_std FROM s""")
def draw_rollup(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_suppkey").alias("sample_id"), (F.col("l_suppkey") % 2).alias("label"), (F.col("l_discount") >= 0.05).cast("int").alias("prediction"))
    return _rounded(M.draw_rollup(d))


@query(f"WITH {PREDS} SELECT run_id, label, round(avg(y_pred), 6) AS probability, count(DISTINCT sample_id) AS n FROM preds GROUP BY 1, 2")
def mean_probability(t: Tables) -> DataFrame:
    return _rounded(M.mean_probability(preds(t), ["run_id", "label"]))


@query(f"WITH {PREDS} SELECT count(y_pred) AS n, round(avg(y_pred), 6) AS mean, round(stddev_samp(y_pred), 6) AS std, round(min(y_pred), 6) AS low, round(quantile_cont(y_pred, 0.25), 6) AS q1, round(quantile_cont(y_pred, 0.5), 6) AS q2, round(quantile_cont(y_pred, 0.75), 6) AS q3, round(max(y_pred), 6) AS high FROM preds")
def describe_scores(t: Tables) -> DataFrame:
    return _rounded(M.described(preds(t), "y_pred"))


_AT = (0.05, 0.25, 0.5, 0.75, 0.999)


@query(f"SELECT l_returnflag, count(l_extendedprice) AS n, {', '.join(f'round(quantile_cont(l_extendedprice, {q}), 6) AS q{k}' for k, q in enumerate(_AT))} FROM lineitem GROUP BY 1")
def quantiles_by_group(t: Tables) -> DataFrame:
    """Selection of ranks in groups of more values than the bound, so that ranges are parted at the smallest scale, too."""
    found = quantiles(t.lineitem, "l_extendedprice", list(_AT), ("l_returnflag",), most=1000)
    return _rounded(found.select("l_returnflag", "n", *[F.get("quantiles", F.lit(k)).alias(f"q{k}") for k in range(len(_AT))]))
