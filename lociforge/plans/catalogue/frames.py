"""Columns and rows of wide tables, orders and choices by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.functions import frames as R
from lociforge.functions.series import running_min
from lociforge.functions.text import substring_first
from lociforge.operators import cohort as C
from lociforge.operators import expression as X
from lociforge.operators import metrics as M
from lociforge.operators import rankings as K
from lociforge.plans.catalogue import Tables, query
from lociforge.plans.catalogue.numerics import _GSEA, _PARTS, _parts
from lociforge.plans.catalogue.scores import PREDS, preds
from lociforge.plans.catalogue.summaries import _rounded
from lociforge.sources.shared import kept


@query("SELECT c_custkey, c_name, upper(c_name) AS symbol, c_acctbal FROM customer")
def insert_after_column(t: Tables) -> DataFrame:
    return R.insert_after(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_name", "symbol", F.upper("c_name"))


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_linestatus FROM lineitem")
def columns_by_name(t: Tables) -> DataFrame:
    return R.columns_where(t.lineitem, lambda c: "disc" in c or "tax" in c or c.endswith("status"), "l_orderkey", "l_linenumber")


@query("SELECT r_regionkey AS region, r_name AS name FROM region")
def strip_header_suffix(t: Tables) -> DataFrame:
    return R.strip_suffix(t.region.select(F.col("r_regionkey").alias("region-x1"), F.col("r_name").alias("name-x1")), "-x1")


@query("SELECT n_nationkey, n_name FROM nation")
def trim_last_columns(t: Tables) -> DataFrame:
    return R.without_last(t.nation.select("n_nationkey", "n_name", "n_regionkey"), 1)


_REGION_CELLS = ", ".join(f"CAST(max(v) FILTER (k = {k}) AS BIGINT) AS \"{k}\"" for k in range(5))


@query(f"""WITH w AS (SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY 1),
  l AS (SELECT k, 'nations' AS "column", nations AS v FROM w UNION ALL SELECT k, 'keys', keys FROM w) SELECT "column", {_REGION_CELLS} FROM l GROUP BY 1""")
def transpose_table(t: Tables) -> DataFrame:
    w = t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("nations"), F.sum("n_nationkey").alias("keys"))
    return R.transposed(w, "k", list(range(5)))


_ROW = "(SELECT *, nullif(l_tax, 0) AS t, nullif(l_discount, 0) AS d FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, greatest(t, d) AS top, round(list_avg(x), 6) AS mean, round(CASE WHEN len(x) > 1 THEN list_stddev_samp(x) END, 6) AS std
  FROM (SELECT l_orderkey, l_linenumber, t, d, list_filter([l_quantity / 50, t, d], lambda v: v IS NOT NULL) AS x FROM {_ROW})""")
def row_statistics(t: Tables) -> DataFrame:
    """Largest, mean and deviation across columns; zeros count as missing."""
    w = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), F.nullif("l_tax", F.lit(0.0)).alias("t"), F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return _rounded(w.select("l_orderkey", "l_linenumber", R.row_max("t", "d").alias("top"), R.row_mean("q", "t", "d").alias("mean"), R.row_std("q", "t", "d").alias("std")))


@query("SELECT event_id FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 1")
def all_ones_rows(t: Tables) -> DataFrame:
    flags = t.events.select("event_id", (F.col("event_id") % 2).alias("a"), (F.col("user_id") % 3).alias("b"))
    return flags.where(R.all_equal(["a", "b"], 1)).select("event_id")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'case' END AS kind FROM customer")
def prefix_cohorts(t: Tables) -> DataFrame:
    """Cases begin with 1_, controls with 0_."""
    name = F.concat((F.col("c_custkey") % 3).cast("string"), F.lit("_"), F.col("c_name"))
    return t.customer.select("c_custkey", R.by_prefix(name, {"1_": "case", "0_": "control"}).alias("kind"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 4000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def masked_range(t: Tables) -> DataFrame:
    mask = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("keep"))
    return R.in_mask(t.customer, F.col("c_acctbal") < 4000, mask, "c_custkey").select("c_custkey", "c_acctbal")


@query("""SELECT 0 AS step, 'all' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'cheap', count(*) FILTER (l_extendedprice < 30000) FROM lineitem
  UNION ALL SELECT 2, 'taxed', count(*) FILTER (l_extendedprice < 30000 AND l_tax > 0.02) FROM lineitem""")
def filter_step_counts(t: Tables) -> DataFrame:
    return R.filter_counts(t.lineitem, {"cheap": F.col("l_extendedprice") < 30000, "taxed": F.col("l_tax") > 0.02})


@query("""SELECT n_nationkey, array_to_string(CASE WHEN n_regionkey = 2 THEN ['a', 'b'] ELSE ['a', 'b', n_name] END, ';') AS joined, split_part(n_name || ';x;y', ';', 1) || ';x' AS first_two,
  n_name || '.csv' AS base, n_name AS stem FROM nation""")
def text_lists(t: Tables) -> DataFrame:
    """Union of arrays, beginning of a list, end of a path, name without ending."""
    a, b = F.array(F.lit("a"), F.lit("b")), F.when(F.col("n_regionkey") != 2, F.array(F.lit("b"), F.col("n_name")))
    path = F.concat(F.lit("runs/1/"), F.col("n_name"), F.lit(".csv"))
    return t.nation.select("n_nationkey", F.array_join(R.joined_arrays(a, b), ";").alias("joined"), R.first_parts(F.concat("n_name", F.lit(";x;y")), 2).alias("first_two"), R.basename(path).alias("base"), R.without_suffix(R.basename(path), ".csv").alias("stem"))


@query("SELECT vec_id, round(s, 5) AS dot, round(1 / (1 + exp(-s)), 5) AS p FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) - 1 AS s FROM embeddings)")
def sigmoid_of_dot(t: Tables) -> DataFrame:
    s = R.dot(F.col("embedding"), F.col("embedding")) - 1
    return t.embeddings.select("vec_id", F.round(s, 5).alias("dot"), F.round(R.sigmoid(s), 5).alias("p"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / (l_tax + 1e-12), 2) AS score FROM lineitem")
def composite_scores(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(R.composite_score(F.col("l_quantity") - 25, F.col("l_tax")), 2).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'NEU' || p_partkey END AS sample FROM part")
def substring_extract(t: Tables) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "x-NEU").otherwise("x-"), F.col("p_partkey").cast("string"), F.lit("-y"))
    return t.part.select("p_partkey", substring_first(text, "(NEU[^-]+)").alias("sample"))


@query("SELECT o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS least FROM orders")
def running_minimum(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice", running_min("o_totalprice", "o_orderkey", by=("o_custkey",)).alias("least"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 >= 0.5 AS INTEGER) AS chosen, CAST(l_discount * 10 > 0.5 AS INTEGER) AS evaluated FROM lineitem")
def thresholds_at_half(t: Tables) -> DataFrame:
    """Both rules for the class of a probability; they differ at one half."""
    p = F.col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", M.at_least(p).alias("chosen"), M.above(p).alias("evaluated"))


_PADJ = "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END"


@query(f"SELECT s_suppkey, {_PADJ} AS padj FROM supplier ORDER BY padj ASC NULLS LAST, s_suppkey LIMIT 40")
def significance_order(t: Tables) -> DataFrame:
    """The 40 most significant rows."""
    return K.by_significance(t.supplier.select("s_suppkey", F.expr(_PADJ).alias("padj")), "padj", "s_suppkey").limit(40)


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, row_number() OVER (ORDER BY c_acctbal DESC, o_custkey) - 1 AS place FROM n JOIN customer ON o_custkey = c_custkey")
def order_of_ranking(t: Tables) -> DataFrame:
    """Counts of all customers that have orders, in the order of their balances, with their places in what was returned."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    ranked = K.in_order_of(counts, t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "c_acctbal")
    # a place is that in the partition, after the rows of those before
    parts = kept(ranked.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")))
    sizes = parts.groupBy("part").agg(F.count("*").alias("c"))
    before = sizes.select("part", F.coalesce(F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(before, "part").select("o_custkey", "n", (F.col("at") + F.col("before")).alias("place"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4000), c_custkey LIMIT 30")
def ascending_by_size(t: Tables) -> DataFrame:
    """The 30 rows nearest to a value."""
    d = t.customer.withColumn("d", F.col("c_acctbal") - 4000)
    return K.ascending(d, "d", "c_custkey", absolute=True).limit(30).select("c_custkey", "c_acctbal")


_ACC = "acc AS (SELECT c_custkey AS id, c_nationkey % 3 AS g, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS accuracy FROM customer)"


@query(f"""WITH {_ACC}, n AS (SELECT count(*) FILTER (g = 0) AS a, count(*) FILTER (g > 0) AS b FROM acc), s AS (SELECT *, CASE WHEN g = 0 THEN 1 ELSE 0 END AS side FROM acc),
  r AS (SELECT *, CASE WHEN side = 0 AND b > a AND accuracy IS NOT NULL THEN row_number() OVER (PARTITION BY side, accuracy IS NULL ORDER BY accuracy DESC, id) WHEN side = 0 AND b > a THEN 1000000000 ELSE 0 END AS r FROM s, n)
  SELECT id, side FROM r WHERE r <= a""")
def balanced_by_accuracy(t: Tables) -> DataFrame:
    """The larger, badly predicted group keeps as many of its best rows as the other has."""
    acc = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("g"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("accuracy"))
    a, b = K.balanced_by_accuracy(acc.where("g > 0"), acc.where("g = 0"), well_a=False)
    return b.select("id", F.lit(1).alias("side")).unionByName(a.select("id", F.lit(0).alias("side")))


_SIDES = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER ({one}) AS one, count(*) FILTER (NOT ({one}) AND {other}) AS other FROM g" for name, (one, other) in K.CONTRASTS.items())


@query(f"WITH g AS (SELECT c_custkey % 2 AS label, c_acctbal > 4000 AS well FROM customer) {_SIDES}")
def contrast_sizes(t: Tables) -> DataFrame:
    g, out = t.customer.select((F.col("c_custkey") % 2).alias("label"), (F.col("c_acctbal") > 4000).alias("well")), None
    for name in K.CONTRASTS:
        one = K.contrast(g, name).agg(F.lit(name).alias("name"), F.count_if(F.col("side") == 1).alias("one"), F.count_if(F.col("side") == 0).alias("other"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey AS id, c_acctbal AS accuracy FROM customer UNION ALL SELECT s_suppkey + 100000000, s_acctbal FROM supplier")
def combined_accuracies(t: Tables) -> DataFrame:
    """Two tables under one name; the third repeats ids of the first, which count once."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("accuracy_mean"))
    b = t.supplier.select((F.col("s_suppkey") + 100000000).alias("id"), F.col("s_acctbal").alias("accuracy_mean"))
    return K.combined_accuracies([a, b, a.withColumn("accuracy_mean", F.lit(-1.0))]).select("id", "accuracy")


@query(f"""WITH {_PARTS}, r AS (SELECT 1 AS k, 'q' AS c, abs(corr(q, e)) AS r FROM p UNION ALL SELECT 2, 'n', abs(corr(n, e)) FROM p) SELECT arg_max(c, r) AS best, round(max(r), 6) AS r FROM r""")
def best_combination(t: Tables) -> DataFrame:
    return K.best_combination(_parts(t), ["q", "n"], 1, "e").select(F.get("columns", F.lit(0)).alias("best"), F.round("r", 6).alias("r"))


_FDR = f"""{_GSEA}, ns AS (SELECT s, es, CASE WHEN es >= 0 THEN es / coalesce((SELECT avg(es) FROM es WHERE es > 0), 1) ELSE es / coalesce((SELECT avg(-es) FROM es WHERE es < 0), 1) END AS nes, row_number() OVER (ORDER BY s) - 1 AS k FROM es),
  dr AS (SELECT run, CAST('0x' || substr(md5(run || '#' || place || '#42'), 1, 8) AS BIGINT) % (SELECT count(*) FROM es) AS k FROM range(100) AS a(run), (SELECT unnest(range((SELECT count(*) FROM es))) AS place)),
  nl AS (SELECT run, es FROM dr JOIN ns USING (k)), nv AS (SELECT es / m AS v FROM nl JOIN (SELECT run, avg(abs(es)) AS m FROM nl GROUP BY 1) USING (run)),
  q AS (SELECT s, nes, ((SELECT count(*) FROM nv WHERE sign(v) = sign(nes) AND abs(v) >= abs(nes)) / CAST((SELECT count(*) FROM nv WHERE sign(v) = sign(nes)) AS DOUBLE)) / ((SELECT count(*) FROM ns b WHERE sign(b.nes) = sign(ns.nes) AND abs(b.nes) >= abs(ns.nes)) / CAST((SELECT count(*) FROM ns b WHERE sign(b.nes) = sign(ns.nes)) AS DOUBLE)) AS q FROM ns)"""


@query(f'WITH {_FDR} SELECT s AS "set", round(least(1, max(q) OVER (PARTITION BY sign(nes) ORDER BY abs(nes) DESC)), 6) AS fdr FROM q')
def resampled_fdr(t: Tables) -> DataFrame:
    ranked = t.part.select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1400 + F.col("p_partkey") % 7).alias("score"))
    sets = t.part.groupBy(F.col("p_type").alias("set")).agg(F.collect_list("p_partkey").alias("genes"))
    return _rounded(K.resampled_fdr(X.normalised_scores(X.enrichment(ranked, sets))).select("set", "fdr"))


@query("SELECT c_acctbal, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def reverse_lookup(t: Tables) -> DataFrame:
    """From a value back to its key."""
    c = t.customer.select("c_acctbal", "c_custkey")
    return C.reverse_lookup(c.select("c_acctbal").distinct(), [c, c.withColumn("c_custkey", F.lit(-1))], "c_acctbal", "c_custkey")


@query("SELECT o_orderkey AS position, o_custkey AS c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def required_lookup(t: Tables) -> DataFrame:
    ids = t.orders.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("c_custkey"))
    return C.required_lookup(t.customer.select("c_custkey", "c_name"), ids, "c_custkey")


@query("SELECT c_custkey AS sample_id, c_name, arg_min(o_orderpriority, o_orderkey) AS \"table\" FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def first_table_of_sample(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("table"), F.col("o_orderkey").alias("run_id"))
    return C.with_first_table(t.customer.select(F.col("c_custkey").alias("sample_id"), "c_name"), rows)


@query(f"WITH {PREDS}, x AS (SELECT sample_id, label, y_pred, run_id FROM preds) SELECT run_id, count(*) AS n, round(avg(y_pred), 6) AS mean, round(avg(y_pred * label), 6) AS other FROM x GROUP BY run_id")
def explained_predictions(t: Tables) -> DataFrame:
    """Explanation vectors as columns, summarised by run."""
    from lociforge.operators.study import explanation_frame

    key = F.struct("run_id", "sample_id").alias("key")
    frame = explanation_frame(preds(t).select(key, F.array("y_pred", F.col("y_pred") * F.col("label")).alias("values")), "values", ["a", "b"], "key")
    return _rounded(frame.groupBy(F.col("key.run_id").alias("run_id")).agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.avg("b").alias("other")))
