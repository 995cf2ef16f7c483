"""Names, keys and attribute strings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitised(name: Column) -> Column:
    """Characters that a run name may not have become '_'; blanks at the ends go."""
    return F.trim(F.regexp_replace(name, r"[^a-zA-Z0-9_\-. /]", "_"))


def attributes(text: Column) -> Column:
    """Entries (key, value) of 'key "value"; key "value"' text. A value without quotes is null; of repeated keys all entries stay."""
    fields = F.filter(F.transform(F.split(text, ";"), lambda f: F.trim(f)), lambda f: f != "")
    quoted = lambda f: F.nullif(F.regexp_extract(f, r'"([^"]*)"', 1), F.lit(""))
    return F.transform(fields, lambda f: F.struct(F.get(F.split(f, " "), F.lit(0)).alias("key"), F.when(f.contains('"'), quoted(f)).alias("value")))


def attribute(text: Column, key: str) -> Column:
    """The value of the key's last entry."""
    return F.try_element_at(F.filter(attributes(text), lambda e: e["key"] == key), F.lit(-1))["value"]


def metric_path(key: Column) -> Column:
    """dataset, table and metric of a path with 2 to 4 parts; null for other paths.

    Of three parts the middle one is a table if the first is 'holdout', else a group, which is left out.
    """
    p = F.split(key, "/")
    part = lambda k: F.get(p, F.lit(k))
    n, none = F.size(p), F.lit(None).cast("string")
    table = F.when((part(0) == "holdout") & (n >= 3), part(1)).otherwise(none)
    known = (n == 2) | (n == 3) | ((n == 4) & (part(0) == "holdout"))
    return F.when(known, F.struct(part(0).alias("dataset"), table.alias("table"), F.element_at(p, -1).alias("metric")))


def run_type(name: Column) -> Column:
    """Kind of a run by the beginning of its name, upper and lower case alike."""
    low = F.lower(name)
    return (
        F.when(low.startswith("bootstrap_"), "bootstrap")
        .when(low.startswith("feature_selection_"), "feature_selection")
        .when(low.startswith("outer_bootstrap_"), "outer_bootstrap")
        .when(low == "summary", "summary")
        .otherwise("model")
    )


def substring_first(text: Column, pattern: str) -> Column:
    """First match of a pattern's first group, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
