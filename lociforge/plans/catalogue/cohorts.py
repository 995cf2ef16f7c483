"""Cohorts, sampling, joins by identifier, set operations, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.frames import merged_maps
from lociforge.functions.text import sanitised
from lociforge.operators import cohort as C
from lociforge.operators.rankings import all_but_last, top_by
from lociforge.plans.catalogue import Tables, query

COHORT = """cohort AS (SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'case' ELSE 'control' END AS label,
  CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_acctbal AS age, c_custkey % 3 AS draw_count, c_nationkey FROM customer)"""


def cohort(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("sample_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "case").otherwise("control").alias("label"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.col("c_acctbal").alias("age"), (F.col("c_custkey") % 3).alias("draw_count"), "c_nationkey",
    )


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedupe_keep_first(t: Tables) -> DataFrame:
    return C.keep_first(t.orders, "o_custkey", F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
def duplicate_keys(t: Tables) -> DataFrame:
    return C.repeated_keys(t.part, "p_name").select("p_partkey", "p_name")


STRATA = f"""{COHORT}, edges AS (SELECT quantile_cont(age, 0.25) AS a, quantile_cont(age, 0.5) AS b, quantile_cont(age, 0.75) AS c FROM cohort),
  strat AS (SELECT cohort.*, sex || '_Q' || CASE WHEN age <= a THEN 1 WHEN age <= b THEN 2 WHEN age <= c THEN 3 ELSE 4 END AS stratum FROM cohort, edges)"""


@query(f"WITH {STRATA} SELECT sample_id, stratum FROM strat")
def quartile_strata(t: Tables) -> DataFrame:
    return C.strata(cohort(t), ["sex", "age"]).select("sample_id", "stratum")


@query(f"""WITH {COHORT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw_count, sample_id) AS n FROM cohort),
  m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM cohort GROUP BY label)) SELECT sample_id, label, draw_count + 1 AS draw_count FROM r, m WHERE n <= least""")
def balance_classes(t: Tables) -> DataFrame:
    return C.balance(cohort(t)).select("sample_id", "label", "draw_count")


SPLIT = f"""{STRATA}, ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(sample_id AS VARCHAR) || '#42'), sample_id) AS n, count(*) OVER (PARTITION BY stratum) AS size FROM strat),
  split AS (SELECT *, CASE WHEN n <= round(size * 0.3) THEN 'test' ELSE 'train' END AS part FROM ranked)"""


@query(f"WITH {SPLIT} SELECT sample_id, stratum, part FROM split")
def stratified_split(t: Tables) -> DataFrame:
    return C.stratified_split(C.strata(cohort(t), ["sex", "age"]), 0.3, 42).select("sample_id", "stratum", "part")


@query(f"""WITH {SPLIT}, r AS (SELECT sample_id, label, part, draw_count, row_number() OVER (PARTITION BY part, label ORDER BY draw_count, sample_id) AS k FROM split),
  m AS (SELECT part, min(c) AS least FROM (SELECT part, label, count(*) AS c FROM split GROUP BY part, label) GROUP BY part)
  SELECT sample_id, r.part, label, draw_count + 1 AS draw_count FROM r JOIN m ON m.part = r.part WHERE k <= least""")
def balanced_train_test(t: Tables) -> DataFrame:
    split = C.stratified_split(C.strata(cohort(t), ["sex", "age"]), 0.3, 42)
    return C.balance(split, within=("part",)).select("sample_id", "part", "label", "draw_count")


@query(f"""WITH {COHORT}, s AS (SELECT *, label || '_' || sex AS stratum FROM cohort), counts AS (SELECT stratum, count(*) AS c FROM s GROUP BY stratum),
  plan AS (SELECT stratum, c, (SELECT least(min(c), 600 // count(*)) FROM counts) AS draws FROM counts), d AS (SELECT stratum, c, unnest(range(1, draws + 1)) AS draw FROM plan),
  p AS (SELECT stratum, draw, CAST('0x' || substr(md5(stratum || '#' || draw || '#7'), 1, 8) AS BIGINT) % c + 1 AS n FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sample_id) AS n FROM s)
  SELECT k.stratum, CAST(draw AS INTEGER) AS draw, sample_id FROM p JOIN k ON k.stratum = p.stratum AND k.n = p.n""")
def bootstrap_within_stratum(t: Tables) -> DataFrame:
    s = cohort(t).withColumn("stratum", F.concat_ws("_", "label", "sex"))
    return C.bootstrap(s, 600, 7).select("stratum", "draw", "sample_id")


@query(f"""WITH {COHORT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR) || '#42'), sample_id) AS n FROM cohort)
  SELECT sample_id, label FROM r WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM cohort GROUP BY label))""")
def random_undersample(t: Tables) -> DataFrame:
    return C.undersample(cohort(t), "label", 42).select("sample_id", "label")


@query(f"""WITH {COHORT}, a AS (SELECT *, row_number() OVER (PARTITION BY sex ORDER BY sample_id) AS n FROM cohort),
  b AS (SELECT sex, label AS permuted, row_number() OVER (PARTITION BY sex ORDER BY md5(CAST(sample_id AS VARCHAR) || '#5'), sample_id) AS n FROM cohort)
  SELECT sample_id, label, permuted FROM a JOIN b ON a.sex = b.sex AND a.n = b.n""")
def label_permutation(t: Tables) -> DataFrame:
    return C.permuted_labels(cohort(t), 5, group="sex").select("sample_id", "label", "permuted")


@query(f"WITH {COHORT} SELECT sample_id, CAST(CAST('0x' || substr(md5(CAST(sample_id AS VARCHAR) || '#3'), 1, 8) AS BIGINT) % 10 AS INTEGER) AS fold FROM cohort")
def cross_validation_folds(t: Tables) -> DataFrame:
    return C.folds(cohort(t), 10, 3).select("sample_id", "fold")


@query("""SELECT n_name, s_name FROM (SELECT n_name, s_name, n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE md5(CAST(n_nationkey AS VARCHAR) || '#9') IN
  (SELECT md5(CAST(n_nationkey AS VARCHAR) || '#9') AS d FROM nation ORDER BY d LIMIT 10)) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY md5(s_name || '#9'), s_name) = 1""")
def random_gene_per_pathway(t: Tables) -> DataFrame:
    """One random member of each of ten random sets."""
    members = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return C.random_members(t.nation, members, "n_nationkey", "s_name", 10, 9).join(t.nation, "n_nationkey").select("n_name", "s_name")


@query("""WITH a AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'x-' || c_custkey || '-y' END AS sample_id FROM customer),
  b AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS genotype_id FROM customer),
  eq AS (SELECT sample_id, genotype_id FROM a JOIN b ON sample_id = genotype_id), rest AS (SELECT * FROM a WHERE sample_id NOT IN (SELECT genotype_id FROM b))
  SELECT * FROM eq UNION ALL SELECT sample_id, min(genotype_id) FROM rest JOIN b ON contains(sample_id, genotype_id) OR contains(genotype_id, sample_id) GROUP BY sample_id""")
def id_mapping_fuzzy(t: Tables) -> DataFrame:
    c = t.customer
    a = c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("x-"), F.col("c_custkey").cast("string"), F.lit("-y"))).alias("sample_id"))
    b = c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("genotype_id"))
    return C.map_ids(a, b)


@query("""SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS phone FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey, s_acctbal, s_name FROM supplier""")
def cohort_union(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("phone"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def cohort_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def cohort_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.select("o_custkey"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def cohort_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def cohort_with_genotype(t: Tables) -> DataFrame:
    """Semi join: samples that have data elsewhere."""
    return C.with_data(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 200000"), "c_custkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_samples(t: Tables) -> DataFrame:
    return C.without_data(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


_WANTED = "CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey END"


@query(f"""SELECT o_orderkey AS position, {_WANTED} AS c_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON {_WANTED} = c_custkey""")
def ordered_lookup(t: Tables) -> DataFrame:
    """Ids that the table lacks are negative ones."""
    ids = t.orders.select(F.col("o_orderkey").alias("position"), F.expr(_WANTED).alias("c_custkey"))
    return C.ordered_lookup(t.customer.select("c_custkey", "c_name", "c_acctbal"), ids, "c_custkey")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
  b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT a.k, CAST(a.n AS INTEGER) AS n, c_custkey, s_suppkey FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def one_to_one_match(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return C.one_to_one(a, b, "k", "c_custkey", "s_suppkey")


@query("""WITH a AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey + 5 AS k, round(sum(s_acctbal), 2) AS b FROM supplier GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, a, b FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_align(t: Tables) -> DataFrame:
    """Keys of the right side are shifted, so that either side has keys of its own."""
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("a"))
    b = t.supplier.groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("b"))
    return a.join(b, "k", "full")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' WHEN c_custkey % 3 = 0 THEN 'third' END AS tab FROM customer""")
def first_match_lookup(t: Tables) -> DataFrame:
    ids = t.customer.select("c_custkey")
    tables = [ids.where("c_custkey % 2 = 0").withColumn("tab", F.lit("even")), ids.where("c_custkey % 3 = 0").withColumn("tab", F.lit("third"))]
    return C.first_match(ids, tables, "c_custkey")


@query("""WITH r AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS p FROM customer) SELECT c_custkey, CASE WHEN p >= 0.85 THEN 'high' ELSE 'low' END AS tail, round(p, 6) AS p FROM r WHERE p >= 0.85 OR p <= 0.15""")
def tail_samples(t: Tables) -> DataFrame:
    r = t.customer.select("c_custkey", ((F.col("c_acctbal") + 1000) / 11000).alias("p"))
    return C.tails(r, "p").select("c_custkey", "tail", F.round("p", 6).alias("p"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, abs(c_acctbal) DESC, c_custkey LIMIT 20")
def multi_key_abs_sort_topn(t: Tables) -> DataFrame:
    return top_by(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), 20, "c_mktsegment", "c_acctbal", "c_custkey")


@query("SELECT n_name, n_nationkey FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey DESC) > 10")
def all_but_last_ten(t: Tables) -> DataFrame:
    return all_but_last(t.nation.select("n_name", "n_nationkey"), 10, "n_nationkey")


@query("SELECT p_partkey, trim(regexp_replace(p_type || '*' || p_brand || '|' || p_name || ' ', '[^a-zA-Z0-9_\\-. /]', '_', 'g')) AS name FROM part")
def sanitize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", sanitised(F.concat("p_type", F.lit("*"), "p_brand", F.lit("|"), "p_name", F.lit(" "))).alias("name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE 'a' END AS x, 'b' AS y FROM nation")
def map_merge(t: Tables) -> DataFrame:
    """Right entries replace left ones of the same key."""
    left = F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("a"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("x"), F.lit("b"), F.lit("y"), F.lit("b"))).otherwise(F.create_map(F.lit("y"), F.lit("b")))
    merged = merged_maps(left, right)
    return t.nation.select("n_nationkey", F.try_element_at(merged, F.lit("x")).alias("x"), F.try_element_at(merged, F.lit("y")).alias("y"))
