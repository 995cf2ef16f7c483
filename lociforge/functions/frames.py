"""Work on columns and rows of wide tables: order and names of columns, values across a row, counted filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def insert_after(df: DataFrame, after: str, name: str, value: Column) -> DataFrame:
    """df with a new column right behind a named one."""
    at = df.columns.index(after) + 1
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*columns[:at], value.alias(name), *columns[at:])


def columns_where(df: DataFrame, wanted: Callable[[str], bool], *always: str) -> DataFrame:
    """The columns whose names are wanted, behind those that are always kept; the order stays."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in always or wanted(c)])


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Names of columns without a suffix."""
    return df.toDF(*[c.removesuffix(suffix) for c in df.columns])


def without_last(df: DataFrame, n: int) -> DataFrame:
    """df without its last n columns."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[: len(df.columns) - n]])


def transposed(df: DataFrame, key: str, keys: list, into: str = "column") -> DataFrame:
    """A row for each column of df, a column for each listed key. The keys are given, so no job finds them."""
    rest = [c for c in df.columns if c != key]
    return df.unpivot(key, rest, into, "_value").groupBy(into).pivot(key, keys).agg(F.first("_value"))


def row_max(*columns: str) -> Column:
    """Largest value of a row; nulls are passed over."""
    return F.greatest(*columns)


def _known(columns: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())


def row_mean(*columns: str) -> Column:
    """Mean over a row's values; nulls are left out, a row of nulls gives null."""
    x = _known(columns)
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(x), F.lit(0))


def row_std(*columns: str) -> Column:
    """Sample deviation over a row's values; null for fewer than two."""
    x, mean = _known(columns), row_mean(*columns)
    squares = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(squares / F.when(F.size(x) > 1, F.size(x) - 1))


def all_equal(columns: list[str], value) -> Column:
    """Every one of the columns has the value; null counts as another."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(value)) for c in columns])


def by_prefix(text: Column, kinds: dict[str, str]) -> Column:
    """The kind whose prefix the text has; null if none."""
    return F.coalesce(*[F.when(text.startswith(p), k) for p, k in kinds.items()])


def in_mask(df: DataFrame, condition: Column, mask: DataFrame, key: str) -> DataFrame:
    """Rows that fulfil a condition and whose key a mask (key, keep) keeps; keys that the mask lacks are left out."""
    return df.where(condition).join(mask.where("keep").select(key).distinct(), key, "left_semi")


def filter_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows are left after each of the conditions in turn: (step, name, n), step 0 being all rows. One pass, no job for each."""
    cells, left = [F.count("*").alias("c0")], F.lit(True)
    for k, c in enumerate(conditions.values(), 1):
        left = left & F.coalesce(c, F.lit(False))
        cells.append(F.count_if(left).alias(f"c{k}"))
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.col(f"c{k}").alias("n")) for k, name in enumerate(["all", *conditions])]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def observed_filters(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df under all conditions, and what is counted while its rows flow: how many were left after each (step_0 being all rows).

    The counts, `get` of the observation, are there once an action on the rows has ended; there is no second job. Every row
    that is read is counted, also by a step that is run again; an action that stops early has seen a part of the rows only.
    """
    cells, left, seen = [F.count("*").alias("step_0")], F.lit(True), Observation()
    for k, c in enumerate(conditions.values(), 1):
        left = left & F.coalesce(c, F.lit(False))
        cells.append(F.count_if(left).alias(f"step_{k}"))
    return df.observe(seen, *cells).where(left), seen


def joined_arrays(*arrays: Column) -> Column:
    """Distinct entries of arrays, in the order in which they first come; a null array has none."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array()) for a in arrays])))


def first_parts(text: Column, n: int = 5, sep: str = ";") -> Column:
    """The first n parts of a list in a text."""
    return F.array_join(F.slice(F.split(text, sep), 1, n), sep)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substr(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def composite_score(log2_fold_change: Column, padj: Column) -> Column:
    """Fold change over the adjusted p, which is kept off 0."""
    return log2_fold_change / (padj + 1e-12)


def merged_maps(left: Column, right: Column) -> Column:
    """Entries of both maps; right ones replace left ones of the same key. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
