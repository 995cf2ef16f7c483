"""Registered queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.collocations import collocations
from lociforge.llm.decontaminate import decontaminate
from lociforge.llm.html_text import html_text
from lociforge.llm.langid import language_id
from lociforge.llm.length_buckets import length_buckets
from lociforge.llm.line_crf import line_quality
from lociforge.llm.lm_score import lm_score
from lociforge.llm.near_dedup import near_dedup
from lociforge.llm.prefix_trie import prefix_trie, turn_arrays
from lociforge.llm.quality import quality_rules
from lociforge.llm.substring_dedup import substring_dedup
from lociforge.llm.token_pack import token_pack
from lociforge.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets(table(spark, sf_dir, "documents"))


def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = token_pack(table(spark, sf_dir, "documents"))
    hashes = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "positions")]
    return packed.select("shard", "row", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "doc_ids", "parts", "cu_seqlens", *hashes)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def fold(n: int, k: int, id_col: str = "doc_id") -> Column:
    """Whether the id's checksum leaves remainder k by n."""
    return F.crc32(F.col(id_col).cast("string")) % n == k


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3, 1))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), fold(3, 1))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), fold(7, 2))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def spliced(turns: DataFrame) -> DataFrame:
    """Conversations of turn_arrays that begin with up to three turns of the one whose id is the next lower multiple of 20."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    joined = turns.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(turn_arrays(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_length_buckets, op2_token_pack, op3_substring_dedup, op4_benchmark_decontamination, op5_quality_rules, op6_minmax_near_dedup, op7_toxicity, op8_language_id, op9_lm_score, op10_html_text, op11_line_quality, op12_collocations, op13_prefix_trie)}


#: Words of every document with their positions, as the contract's pattern takes them.
_WORDS = r"""docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

_OP3 = rf"""
WITH {_WORDS},
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM docs WHERE len(w) >= 13),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS owner FROM wins GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM wins JOIN firsts USING (s), range(0, 13) AS r(k) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""

_OP4 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, item, places.n, p FROM places JOIN wins ON wins.n = places.n AND wins.s = array_to_string(w[p:p + places.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM found, range(0, 13) AS r(k) WHERE k < found.n GROUP BY doc_id),
has AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(has.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit ON hit.doc_id = docs.doc_id LEFT JOIN has ON has.doc_id = docs.doc_id
"""

_OP5 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM docs WHERE len(w) >= 5),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM starts),
twice AS (SELECT doc_id, s FROM wins GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM wins JOIN twice USING (doc_id, s), range(0, 5) AS r(k) GROUP BY doc_id),
base AS (SELECT docs.doc_id, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM docs LEFT JOIN rep ON rep.doc_id = docs.doc_id),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(l) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < n_words) AS kept
FROM failed
"""

_OP6 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM docs WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + n - 1], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT id, y FROM reach JOIN edges ON r = x),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM docs JOIN comp ON id = doc_id LEFT JOIN sizes USING (doc_id)
"""

_OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM lists),
grams AS (SELECT lang, w[p:p + k - 1] AS g FROM starts, range(1, 6) AS t(k) WHERE p + k - 1 <= len(w)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
cand AS (SELECT lang, g, f AS a FROM counts WHERE len(g) >= 2),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
scored AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
           FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
subs AS (SELECT lang, a AS longer, g[p:p + k - 1] AS g FROM cand, range(2, 5) AS t(k), range(1, 5) AS u(p) WHERE k < len(cand.g) AND p + k - 1 <= len(cand.g)),
gone AS (SELECT DISTINCT s.lang, s.g FROM subs s JOIN cand c ON c.lang = s.lang AND c.g = s.g WHERE 100 * longer >= 100 * a),
kept AS (SELECT best.* FROM best LEFT JOIN gone ON gone.lang = best.lang AND gone.g = best.g WHERE gone.lang IS NULL),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_OP13 = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, sha256(concat(length(r), ':', r, t))) AS a FROM said GROUP BY conv_id),
heads AS (SELECT conv_id, a, conv_id - conv_id % 20 AS base, list_reduce(list_concat([4294967295::BIGINT],
            flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM own),
built AS (SELECT h.conv_id, list_concat(coalesce(b.a, [])[1:xor(h.crc, 4294967295) % 4], h.a[xor(h.crc, 4294967295) % 4 + 1:]) AS s
          FROM heads h LEFT JOIN own b ON b.conv_id = h.base),
begun AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built),
nodes AS (SELECT d, s[1:d] AS k, min(conv_id) AS id, count(*) AS n, coalesce(string_agg(CASE WHEN len(s) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS e
          FROM begun GROUP BY d, s[1:d]),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d - 1, k[1:d - 1]),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids,
               CASE WHEN nodes.d > 0 THEN (nodes.n - 1) * len(regexp_extract_all(nodes.k[nodes.d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own
               FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.k = nodes.k),
ups AS (SELECT unnest(range(0, d + 1)) AS e, k, kids, own FROM full_nodes),
sub AS (SELECT e AS d, k[1:e] AS k, count(*) FILTER (kids = 0) AS leaves, sum(own) AS saved FROM ups GROUP BY e, k[1:e])
SELECT x.id AS conv_id, x.d AS depth, p.id AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(x.e) AS ends_sha256
FROM full_nodes x JOIN sub ON sub.d = x.d AND sub.k = x.k LEFT JOIN nodes p ON p.d = x.d - 1 AND p.k = x.k[1:x.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _OP3, "op4_benchmark_decontamination": _OP4, "op5_quality_rules": _OP5, "op6_minmax_near_dedup": _OP6, "op12_collocations": _OP12, "op13_prefix_trie": _OP13}
