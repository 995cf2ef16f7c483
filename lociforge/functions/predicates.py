"""User predicates: SQL conditions, never code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|&&?|\|\|?|==|~|[^'\"`&|=~]+|=")


def condition(text: str) -> Column:
    """A condition in SQL, or in the style of frame queries (&, |, ==, ~ outside of quotes are and, or, =, not)."""
    words = {"&": " AND ", "&&": " AND ", "|": " OR ", "||": " OR ", "==": " = ", "~": " NOT "}
    return F.expr("".join(words.get(p, p) for p in _PARTS.findall(text)))


def holds_genes(genes: list[str] | str, every: bool = False, column: str = "genes") -> Column:
    """Whether a gene set has any (or every one) of the genes; a null set has none."""
    wanted = [genes] if isinstance(genes, str) else genes
    hits = [F.coalesce(F.array_contains(column, g), F.lit(False)) for g in wanted]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits, F.lit(every))


def filtered(df: DataFrame, text: str | None) -> DataFrame:
    return df.where(condition(text)) if text else df
