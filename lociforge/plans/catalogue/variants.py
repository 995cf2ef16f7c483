"""Genotypes, variants, intervals and gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.predicates import holds_genes
from lociforge.functions import genotype as G
from lociforge.functions.text import attribute, metric_path
from lociforge.operators import intervals as I
from lociforge.operators import variants as V
from lociforge.plans.catalogue import Tables, query


def contig(k) -> F.Column:
    n = 1 + F.col(k) % 25
    return F.concat(F.lit("chr"), F.when(n == 23, "X").when(n == 24, "Y").when(n == 25, "MT").otherwise(n.cast("string")))


def contig_sql(k: str) -> str:
    return f"('chr' || CASE 1 + {k} % 25 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' ELSE CAST(1 + {k} % 25 AS VARCHAR) END)"


def entries(t: Tables) -> DataFrame:
    """Stand-in calls: one for each part (variant) and supplier (sample)."""
    code = F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0.05) & (F.col("l_tax") < 0.03), 9).when(F.col("l_linenumber") == 1, 2).when(F.col("l_linenumber") == 2, 1).otherwise(0)
    return t.lineitem.groupBy(contig("l_partkey").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("sample_id")).agg(F.nullif(F.max(code), F.lit(9)).alias("gt"))


ENTRIES = f"""entries AS (SELECT {contig_sql("l_partkey")} AS contig, l_partkey AS pos, l_suppkey AS sample_id,
  nullif(max(CASE WHEN l_linenumber = 7 AND l_discount = 0.05 AND l_tax < 0.03 THEN 9 WHEN l_linenumber = 1 THEN 2 WHEN l_linenumber = 2 THEN 1 ELSE 0 END), 9) AS gt
  FROM lineitem GROUP BY 1, 2, 3)"""
GENES = f"genes AS (SELECT {contig_sql('s_suppkey')} AS contig, s_suppkey * 20 AS start_pos, s_suppkey * 20 + 800 AS end_pos, s_name AS gene_name FROM supplier)"
STATS = f"{ENTRIES}, stats AS (SELECT contig, pos, avg(gt) / 2 AS maf, stddev_pop(gt) AS sd, bool_or(gt IS NULL) AS has_missing, count(*) AS n FROM entries GROUP BY contig, pos)"
QC = f"{STATS}, qc AS (SELECT * FROM stats WHERE maf > 0 AND maf < 1 AND regexp_matches(contig, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|.*_alt|.*_PAR)$') AND maf BETWEEN 0.005 AND 1 AND NOT has_missing)"


def genes(t: Tables) -> DataFrame:
    return t.supplier.select(contig("s_suppkey").alias("contig"), (F.col("s_suppkey") * 20).alias("start_pos"), (F.col("s_suppkey") * 20 + 800).alias("end_pos"), F.col("s_name").alias("gene_name"))


CALLS = "('0/0', '0|1', '1/2', '2/2', './.')"


def _calls(t: Tables) -> DataFrame:
    call = F.element_at(F.array(*map(F.lit, ("0/0", "0|1", "1/2", "2/2", "./."))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", call.alias("call"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS gt,
  CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS alts FROM lineitem""")
def genotype_coding_zygosity(t: Tables) -> DataFrame:
    return _calls(t).select("l_orderkey", "l_linenumber", G.zygosity(F.col("call")).alias("gt"), F.when(G.alleles_of(F.col("call")).isNotNull(), G.n_alt(F.col("call"))).alias("alts"))


@query("SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS gt FROM lineitem")
def genotype_coding_binary(t: Tables) -> DataFrame:
    return _calls(t).select("l_orderkey", "l_linenumber", G.binarised(F.col("call")).alias("gt"))


@query(f"WITH {STATS} SELECT contig, pos, round(maf, 6) AS maf, round(sd, 6) AS stdev, has_missing, n AS n_samples FROM stats")
def variant_qc_stats(t: Tables) -> DataFrame:
    return V.variant_stats(entries(t)).select("contig", "pos", F.round("maf", 6).alias("maf"), F.round("stdev", 6).alias("stdev"), "has_missing", "n_samples")


@query(f"WITH {QC} SELECT contig, pos, round(maf, 6) AS maf, contig || ':' || pos AS variant_id FROM qc")
def variant_qc_filter(t: Tables) -> DataFrame:
    return V.qc_variants(entries(t)).select("contig", "pos", F.round("maf", 6).alias("maf"), "variant_id")


@query(f"WITH {QC}, {GENES}, near AS (SELECT * FROM qc WHERE EXISTS (SELECT 1 FROM genes g WHERE g.contig = qc.contig AND qc.pos BETWEEN g.start_pos AND g.end_pos)) SELECT contig, count(*) AS n_variants, round(avg(maf), 6) AS mean_maf FROM near GROUP BY contig")
def flagship_variants_per_contig(t: Tables) -> DataFrame:
    """Quality-controlled variants inside genes, counted by contig."""
    near = I.interval_semi_join(V.qc_variants(entries(t)), genes(t))
    return near.groupBy("contig").agg(F.count("*").alias("n_variants"), F.round(F.avg("maf"), 6).alias("mean_maf"))


@query(f"SELECT p_partkey, {contig_sql('p_partkey')} AS contig FROM part WHERE regexp_matches({contig_sql('p_partkey')}, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|.*_alt|.*_PAR)$')")
def contig_regex_filter(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", contig("p_partkey").alias("contig")).where(F.col("contig").rlike(G.CONTIG_PATTERN))


@query("SELECT p_partkey FROM part WHERE len(list_filter([substr(p_name, 1, 1), substr(p_name, 2, CAST(p_partkey % 3 AS INTEGER))], lambda a: length(a) <> 1)) = 0")
def snp_allele_filter(t: Tables) -> DataFrame:
    alleles = F.array(F.substring("p_name", 1, 1), F.substr("p_name", F.lit(2), (F.col("p_partkey") % 3).cast("int")))
    return t.part.where(G.is_snp(alleles)).select("p_partkey")


@query("""SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'chrUn' ELSE 'chr' || p_partkey % 22 END AS contig, CASE WHEN p_partkey % 4 < 2 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS pos
  FROM part""")
def variant_id_parse(t: Tables) -> DataFrame:
    """A quarter of the names are null, a quarter have no position."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "chrUn").otherwise(G.variant_id(F.concat(F.lit("chr"), (k % 22).cast("string")), k))
    c, p = G.parse_variant_id(name)
    return t.part.select("p_partkey", "p_name", F.concat(F.lit("chr"), c).alias("contig"), p.alias("pos"))


_POINTS = f"points AS (SELECT {contig_sql('p_partkey')} AS contig, p_partkey AS pos FROM part)"


def _points(t: Tables) -> DataFrame:
    return t.part.select(contig("p_partkey").alias("contig"), F.col("p_partkey").alias("pos"))


@query(f"WITH {_POINTS}, {GENES} SELECT contig, pos FROM points WHERE EXISTS (SELECT 1 FROM genes g WHERE g.contig = points.contig AND pos BETWEEN start_pos AND end_pos)")
def interval_semi_join(t: Tables) -> DataFrame:
    return I.interval_semi_join(_points(t), genes(t))


@query(f"WITH {_POINTS}, {GENES} SELECT p.contig, pos, coalesce(string_agg(DISTINCT gene_name, ',' ORDER BY gene_name), 'N/A') AS names FROM points p LEFT JOIN genes g ON g.contig = p.contig AND pos <= end_pos AND pos + 1 >= start_pos GROUP BY p.contig, pos")
def interval_overlap_genes(t: Tables) -> DataFrame:
    return I.overlap_names(_points(t), genes(t), width=500)


@query("""WITH sets AS (SELECT n_name AS gene_set, list(s_name) AS genes FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name)
  SELECT s_suppkey, s_name FROM supplier WHERE s_name IN (SELECT DISTINCT unnest(genes) FROM sets)""")
def gene_set_semi_join(t: Tables) -> DataFrame:
    sets = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.collect_list("s_name").alias("genes"))
    wanted = sets.select(F.explode("genes").alias("s_name")).distinct()
    return t.supplier.join(wanted, "s_name", "left_semi").select("s_suppkey", "s_name")


@query("SELECT p_type AS gene_set, count(*) AS size FROM part GROUP BY 1 HAVING bool_or(p_partkey = 7) OR bool_or(p_partkey = 11)")
def gene_set_filter(t: Tables) -> DataFrame:
    """Sets that hold one of two genes."""
    sets = t.part.groupBy(F.col("p_type").alias("gene_set")).agg(F.collect_list(F.col("p_partkey").cast("string")).alias("genes"))
    return sets.where(holds_genes(["7", "11"])).select("gene_set", F.size("genes").cast("long").alias("size"))


_PARTS = list(range(1, 16))


@query(f"WITH {ENTRIES} SELECT sample_id, {', '.join(f'''CAST(max(gt) FILTER (pos = {k}) AS INTEGER) AS v{k}''' for k in _PARTS)} FROM entries WHERE pos <= {_PARTS[-1]} GROUP BY sample_id")
def genotype_pivot(t: Tables) -> DataFrame:
    long = entries(t).where(F.col("pos") <= _PARTS[-1]).select("sample_id", F.concat(F.lit("v"), F.col("pos").cast("string")).alias("variant_id"), "gt")
    return V.pivot_genotypes(long, [f"v{k}" for k in _PARTS])


@query(f"WITH {ENTRIES} SELECT sample_id, list(pos ORDER BY pos) AS positions, list(gt ORDER BY pos) AS calls FROM (SELECT sample_id, pos, max(gt) AS gt FROM entries WHERE gt <> 0 GROUP BY 1, 2) GROUP BY sample_id")
def genotype_vectors(t: Tables) -> DataFrame:
    e = entries(t).withColumn("variant_id", F.col("pos"))
    return V.genotype_vectors(e, t.part.select(F.col("p_partkey").alias("variant_id"), F.col("p_partkey").alias("position")))


@query("""SELECT p_partkey, 'G' || p_partkey AS gene_id, CAST(NULL AS VARCHAR) AS level, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS gene_name, p_type AS tag FROM part""")
def attribute_map_parse(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' gene_name "'), "p_name", F.lit('";'))).otherwise("")
    text = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; level 2;'), name, F.lit(' tag "first"; tag "'), "p_type", F.lit('";'))
    return t.part.select("p_partkey", text.alias("a")).select("p_partkey", *[attribute(F.col("a"), k).alias(k) for k in ("gene_id", "level", "gene_name", "tag")])


METRICS = """metrics AS (SELECT user_id AS run_id, event_id, CASE event_id % 5 WHEN 0 THEN 'train/' || event_type WHEN 1 THEN 'test/' || event_type WHEN 2 THEN 'test/group/' || event_type
  WHEN 3 THEN 'holdout/T' || (event_id % 2) || '/' || event_type ELSE CASE WHEN event_id % 2 = 0 THEN 'holdout/T' || (event_id % 3) || '/confusion/' || event_type ELSE event_type END END AS key, value FROM events)"""


def metrics(t: Tables) -> DataFrame:
    """Stand-in run metrics under path keys."""
    e, kind = F.col("event_id"), F.col("event_type")
    holdout = lambda n, *rest: F.concat(F.lit("holdout/T"), (e % n).cast("string"), F.lit("/"), *rest)
    key = (
        F.when(e % 5 == 0, F.concat(F.lit("train/"), kind)).when(e % 5 == 1, F.concat(F.lit("test/"), kind)).when(e % 5 == 2, F.concat(F.lit("test/group/"), kind))
        .when(e % 5 == 3, holdout(2, kind)).when(e % 2 == 0, holdout(3, F.lit("confusion/"), kind)).otherwise(kind)
    )
    return t.events.select(F.col("user_id").alias("run_id"), "event_id", key.alias("key"), "value")


#: Long metrics in SQL, as metric_path reads the keys.
LONG = f"""{METRICS}, long AS (SELECT run_id, event_id, string_split(key, '/')[1] AS dataset, CASE WHEN string_split(key, '/')[1] = 'holdout' AND len(string_split(key, '/')) >= 3 THEN string_split(key, '/')[2] END AS tab,
  string_split(key, '/')[-1] AS metric, value FROM metrics WHERE len(string_split(key, '/')) IN (2, 3) OR (len(string_split(key, '/')) = 4 AND string_split(key, '/')[1] = 'holdout'))"""


def long_metrics(t: Tables) -> DataFrame:
    return metrics(t).withColumn("p", metric_path(F.col("key"))).where("p is not null").select("run_id", "event_id", "p.dataset", F.col("p.table").alias("tab"), "p.metric", "value")


@query(f"WITH {LONG} SELECT * FROM long")
def metric_path_reshape(t: Tables) -> DataFrame:
    return long_metrics(t)
