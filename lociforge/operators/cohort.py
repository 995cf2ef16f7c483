"""Cohorts: strata, splits, balancing, resampling, identifiers. Every draw is ordered by a digest of id and seed.

So a draw needs no driver state, is the same on any cluster, and can be repeated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.functions.series import placed
from lociforge.operators.quantiles import quantiles


def draw_order(key: Column, seed: int | str) -> Column:
    """Seeded random order of keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def keep_first(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once. A semi join on counted keys: no window holds a frequent key's rows."""
    return df.join(df.groupBy(key).count().where("count > 1").select(key), key, "left_semi")


def quartile_edges(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row: for each column an array of its five quartile edges, equal ones once; null for a column without values.

    Exact ones are selected by counted ranges; for approximate ones in one pass take exact=False.
    """
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    if not exact:
        return df.agg(*[F.array_distinct(F.percentile_approx(F.col(c), at, 100_000)).alias(f"{c}_edges") for c in columns])
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.*")
    return quantiles(cells, "v", at, ("k",)).agg(*[F.array_distinct(F.max(F.when(F.col("k") == k, F.col("quantiles")))).alias(f"{c}_edges") for k, c in enumerate(columns)])


def _below(edges: Column, value: Column) -> Column:
    return F.filter(edges, lambda e: e < value)


def strata(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Adds stratum: numeric columns by quartile bin (Q1 to Q4, fewer where edges coincide, 'nan' for null), others as they are, joined by '_'.

    A numeric column whose edges all coincide cannot be binned and gives 'Unknown'. Underscores at the end go.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    out = df.crossJoin(F.broadcast(quartile_edges(df, numeric, exact))) if numeric else df
    parts = []
    for c in columns:
        if c in numeric:
            edges = F.col(f"{c}_edges")
            number = F.greatest(F.lit(1), F.size(_below(edges, F.col(c))))
            parts.append(F.when(F.size(edges) < 2, "Unknown").when(F.col(c).isNull(), "nan").otherwise(F.concat(F.lit("Q"), number.cast("string"))))
        else:
            parts.append(F.coalesce(F.col(c).cast("string"), F.lit("nan")))
    return out.withColumn("stratum", F.rtrim(F.concat_ws("_", *parts), F.lit("_"))).drop(*[f"{c}_edges" for c in numeric])


def drawn(df: DataFrame, by: list[str], key: str, seed: int | str, digest: Column | None = None) -> DataFrame:
    """Adds _n, a row's place in the seeded order of its group, and _size, the group's rows.

    Digests are spread evenly, so the first two digits deal a group to 256 parts, which are numbered on their own and
    shifted by the parts before: two labels do not mean two tasks. `digest`, if given, orders in place of that of key and seed.
    """
    order = draw_order(F.col(key), seed) if digest is None else digest
    parts = df.withColumn("_d", order).withColumn("_part", F.substring("_d", 1, 2))
    sizes = parts.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by or (F.lit(0),))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"_by{k}" for k, c in enumerate([*by, "_part"])}
    sizes = sizes.select(*[F.col(c).alias(n) for c, n in names.items()], before.alias("_before"), F.sum("_c").over(w).alias("_size"))
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_d", key))
    return parts.withColumn("_inside", inside).join(sizes, on).withColumn("_n", F.col("_inside") + F.col("_before")).drop("_d", "_part", "_inside", "_before", *names.values())


def stratified_split(df: DataFrame, test_size: float, seed: int | str, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """Adds part, 'test' for round(n * test_size) of each stratum's n rows, 'train' for the rest."""
    cut = F.round(F.col("_size") * test_size)
    return drawn(df, [stratum], key, seed).withColumn("part", F.when(F.col("_n") <= cut, "test").otherwise("train")).drop("_n", "_size")


def balance(df: DataFrame, label: str = "label", draws: str = "draw_count", key: str = "sample_id", within: tuple[str, ...] = ()) -> DataFrame:
    """As many rows of each label as the rarest label has, those drawn least often first; draws counts one more."""
    sizes = df.groupBy(*within, label).count().groupBy(*within).agg(F.min("count").alias("_least"))
    joined = df.join(sizes, list(within)) if within else df.crossJoin(F.broadcast(sizes))
    return placed(joined, "_n", [F.col(draws), F.col(key)], (*within, label)).where("_n <= _least").withColumn(draws, F.col(draws) + 1).drop("_n", "_least")


def undersample(df: DataFrame, label: str, seed: int | str, key: str = "sample_id") -> DataFrame:
    """A random choice of the larger groups, as large as the smallest."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return drawn(df, [label], key, seed).crossJoin(F.broadcast(least)).where("_n <= _least").drop("_n", "_size", "_least")


def bootstrap(df: DataFrame, size: int, seed: int | str, stratum: str = "stratum", key: str = "sample_id") -> DataFrame:
    """Draws with replacement: from each stratum min(smallest stratum, size // strata) rows; draw numbers them from 1."""
    counts = df.groupBy(stratum).count()
    plan = counts.crossJoin(F.broadcast(counts.agg(F.least(F.min("count"), F.floor(F.lit(size) / F.count("*")).cast("long")).alias("_draws"))))
    digest = F.md5(F.concat(F.col(stratum).cast("string"), F.lit("#"), F.col("draw").cast("string"), F.lit(f"#{seed}")))
    picks = plan.where("_draws > 0").select(stratum, "count", F.explode(F.sequence(F.lit(1), F.col("_draws").cast("int"))).alias("draw")).withColumn("_n", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("count") + 1)
    numbered = placed(df, "_n", [F.col(key)], (stratum,))
    return numbered.join(picks.select(stratum, "draw", "_n"), [stratum, "_n"]).drop("_n")


def permuted_labels(df: DataFrame, seed: int | str, label: str = "label", key: str = "sample_id", group: str | None = None) -> DataFrame:
    """Labels shuffled among the rows (of each group): the row that is n-th by id gets the label of the n-th in random order."""
    by = [group] if group else []
    own = placed(df, "_n", [F.col(key)], tuple(by))
    other = drawn(df, by, key, seed).select(*by, F.col(label).alias("permuted"), "_n")
    return own.join(other, [*by, "_n"]).drop("_n")


def folds(df: DataFrame, n: int, seed: int | str, key: str = "sample_id") -> DataFrame:
    """Adds fold, 0 to n - 1, from a digest of the id."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int"))


def _containing(long: DataFrame, a: str, short: DataFrame, b: str) -> DataFrame:
    """Pairs (a, b) of which a contains b: the substrings of a that are as long as any b, which meet the b in an equal join.

    Lengths of ids are few, whatever the number of ids; they travel as one row.
    """
    sizes = short.agg(F.collect_set(F.length(b)).alias("_sizes"))
    text = F.col(a)
    cuts = F.transform("_sizes", lambda n: F.when(n <= F.length(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda k: F.substr(text, k, n))).otherwise(F.array().cast("array<string>")))
    parts = long.crossJoin(F.broadcast(sizes)).select(a, F.explode(F.array_distinct(F.flatten(cuts))).alias("_part"))
    return parts.join(short, F.col("_part") == F.col(b)).select(a, b)


def map_ids(left: DataFrame, right: DataFrame, a: str = "sample_id", b: str = "genotype_id") -> DataFrame:
    """(a, b): for each a an equal b; failing that the smallest b that contains a or is contained in it; else no row.

    Equal ids meet in a hash join; the rest is compared by content, against the distinct ids. Null and empty ids match nothing
    by content.
    """
    ids, others = left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct()
    same = ids.join(others, F.col(a) == F.col(b))
    rest, known = ids.join(others, F.col(a) == F.col(b), "left_anti").where(F.length(a) > 0), others.where(F.length(b) > 0)
    alike = _containing(rest, a, known, b).unionByName(_containing(known, b, rest, a)).groupBy(a).agg(F.min(b).alias(b))
    return same.unionByName(alike)


def reverse_lookup(wanted: DataFrame, tables: list[DataFrame], value: str, key: str) -> DataFrame:
    """For each wanted value the smallest key that has it in the first table in which any has; null if none has."""
    return first_match(wanted, [t.groupBy(value).agg(F.min(key).alias(key)) for t in tables], value)


def required_lookup(df: DataFrame, ids: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of df for the listed ids in the order of the list; a job fails at the first id that df lacks."""
    found = ids.join(df.withColumn("_there", F.lit(True)), key, "left")
    lacks = F.raise_error(F.concat(F.lit("no row of "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(position, F.when(F.col("_there"), F.col(position)).otherwise(lacks)).drop("_there").orderBy(position)


def with_first_table(summary: DataFrame, rows: DataFrame, key: str = "sample_id", table: str = "table", order: str = "run_id") -> DataFrame:
    """Summaries of samples with the table that a sample's first row names; samples without rows are left out."""
    return summary.join(rows.groupBy(key).agg(F.min_by(table, order).alias(table)), key)


def ordered_lookup(df: DataFrame, ids: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of df for the listed ids, with their place in the list; an id that df lacks keeps its place with nulls."""
    return ids.join(df, key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Pairs the n-th row of a key on the left with the n-th on the right; what has no partner is left out."""
    number = lambda df, order: df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [key, "_n"]).withColumnRenamed("_n", "n")


def first_match(wanted: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """For each wanted key its row in the first table that has it; tables share a schema."""
    from functools import reduce

    numbered = [d.withColumn("_t", F.lit(k)) for k, d in enumerate(tables)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), numbered)
    return wanted.join(keep_first(every, key, F.col("_t").asc()), key, "left").drop("_t")


def check_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; else an error that names those it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def check_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """df with a guard: a job fails at the first row whose value is not allowed."""
    return df.withColumn(column, F.when(F.lower(column).isin(allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} may not be "), F.coalesce(F.col(column), F.lit("null"))))))


def with_data(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in the other table, each once; a null key does not."""
    return df.join(other.select(F.col(other_key or key).alias(key)), key, "left_semi").select(*df.columns)


def without_data(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in the other table, those with a null key among them."""
    return df.join(other.select(F.col(other_key or key).alias(key)), key, "left_anti").select(*df.columns)


def tails(df: DataFrame, p: str, low: float = 0.15, high: float = 0.85, into: str = "tail") -> DataFrame:
    """Rows with p at one of the ends, told apart as 'low' and 'high'; a null p is at none."""
    return df.where((F.col(p) >= high) | (F.col(p) <= low)).withColumn(into, F.when(F.col(p) >= high, "high").otherwise("low"))


def random_members(groups: DataFrame, members: DataFrame, key: str, member: str, n: int, seed: int | str) -> DataFrame:
    """(key, member): one random member of each of n random groups; groups without members are left out."""
    chosen = groups.select(key).distinct().orderBy(draw_order(F.col(key), seed)).limit(n)
    own = members.join(chosen, key)
    return own.groupBy(key).agg(F.min_by(member, F.struct(draw_order(F.col(member), seed), member)).alias(member))
