"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a text under which it is rejected. On a bounded sample each rule is run alone: the share that
it rejects and the time that it takes give rejections per cost, and the rules are tried in that order. A text that one
rule rejects is not looked at by the next, so the dear rules see few texts. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.sample import bounded
from lociforge.llm.store import written

#: Rows on which costs and selectivities are estimated, and how many copies of them a rule is timed on.
SAMPLE_ROWS, REPEAT = 2000, 2
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_counts(text: Column) -> Column:
    return _let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def repeated_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that the text has twice or more, the first occurrence included."""

    def windows(h: Column) -> Column:
        n = F.size(h) - WINDOW + 1
        return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(x: Column) -> Column:
        return _let(F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: _let(places(s), spread))

    def places(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["v"] == F.get(s, b)["v"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def spread(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda n, g: n + g)

    return _let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: _let(windows(h), lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0))),
    ).cast("long")


class Measures:
    """What rules look at: the text, its words, and measures of both; a measure that is already known is not computed again."""

    def __init__(self, text: Column, w: Column, known: dict[str, Column] | None = None):
        self.text, self.words, self.known = text, w, known or {}

    def _get(self, name: str, value: Callable[[], Column]) -> Column:
        return self.known[name] if name in self.known else value()

    @property
    def n_words(self) -> Column:
        return self._get("n_words", lambda: F.size(self.words).cast("long"))

    @property
    def word_chars(self) -> Column:
        return self._get("word_chars", lambda: word_chars(self.words))

    @property
    def n_symbols(self) -> Column:
        return self._get("n_symbols", lambda: symbols(self.text))

    @property
    def n_repeat_words(self) -> Column:
        return self._get("n_repeat_words", lambda: repeated_words(self.words))

    @property
    def line_counts(self) -> Column:
        """A structure of all lines with a word (n) and those that are repeats (dup)."""
        return self._get("line_counts", lambda: line_counts(self.text))


@dataclass(frozen=True)
class Rule:
    """rejects(measures): when a text is rejected; base: whether the rule belongs to the fixed base rules."""

    name: str
    rejects: Callable[[Measures], Column]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m.n_words < 10, True),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 20 * m.n_words, True),
    Rule("symbols", lambda m: 2 * m.n_symbols > m.n_words),
    Rule("duplicate_lines", lambda m: _let(m.line_counts, lambda x: 10 * x["dup"] > 3 * x["n"])),
    Rule("word_length", lambda m: _let(m.word_chars, lambda x: (x < 2 * m.n_words) | (x > 15 * m.n_words))),
    Rule("letters", lambda m: 2 * F.size(F.filter(m.words, lambda x: x.rlike(r"\p{L}"))) < m.n_words),
)


def _seconds(df: DataFrame, times: int) -> float:
    """The least time of several runs of a job that only counts."""
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        df.count()
        best = min(best, time.perf_counter() - began)
    return best


def ordered(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, times: int = 2) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on a sample of df: (rule, share rejected, seconds).

    The sample is held with its words split. A rule's cost is the least time of several runs over REPEAT copies of each
    row, less that of a job over the same rows that evaluates no rule, so neither a job's start nor the split, which all
    rules share, counts; it is at least a hundredth of the dearest one's, below which times are noise and the rule that
    rejects more goes first.
    """
    sample = bounded(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, "id")
    sample = written(sample.repartition(8).select("text", words(F.col("text")).alias("w")))
    m = Measures(F.col("text"), F.col("w"))
    copies = sample.crossJoin(F.broadcast(df.sparkSession.range(REPEAT).select(F.col("id").alias("copy"))))
    # each copy has its own text and words, so that nothing is computed once for all; what the rule says is summed, not filtered
    copies = copies.select(F.concat("text", F.col("copy").cast("string")).alias("text"), F.concat("w", F.array(F.col("copy").cast("string"))).alias("w"))
    shares = sample.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(r.rejects(m), F.lit(False))).alias(r.name) for r in rules]).first()
    base = _seconds(copies.where(F.length("text") + F.size("w") >= 0), times)
    costs = [max(_seconds(copies.where(F.coalesce(r.rejects(m), F.lit(False))), times) - base, 0.0) for r in rules]
    least = max(max(costs, default=0.0) / 100, 1e-4)
    out = [(r, shares[r.name] / max(shares.n, 1), max(c, least)) for r, c in zip(rules, costs, strict=True)]
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def verdict(rules: list[Rule], m: Measures) -> Column:
    """False as soon as a rule rejects; the rules after it are not evaluated."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(F.coalesce(rule.rejects(m), F.lit(False)), False).otherwise(kept)
    return kept


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures of every text, and whether the cascade keeps it.

    Returns for each row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    Null and empty texts have no words and fail; null ids stay, rows that repeat an id are each judged. An empty table
    gives an empty result. Rules take the measures that are returned as they are; nothing is computed twice.
    """
    order = [r for r, _, _ in ordered(df, tuple(r for r in rules if not r.base), text_col, id_col, sample_rows)]

    def judged(text: Column) -> Column:
        def of_words(w: Column) -> Column:
            def of_measures(x: Column) -> Column:
                failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
                known = {k: x[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "line_counts")}
                kept = F.when(failed, False).otherwise(verdict(order, Measures(text, w, known)))
                return F.struct(*[x[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")], x["line_counts"]["dup"].alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"))

            m = Measures(text, w)
            return _let(F.struct(m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), m.line_counts.alias("line_counts"), m.n_repeat_words.alias("n_repeat_words")), of_measures)

        return _let(words(text), of_words)

    # a generator is not merged with the projection before it, so the structure's fields do not each repeat the work
    out = df.select(F.col(id_col).alias("id"), F.explode(F.array(judged(F.col(text_col)))).alias("q"))
    return out.select(F.col("id").alias(id_col), *[F.col("q")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def quality_filter(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df, all columns, that no rule rejects; each rule sees only what those before it let through.

    Words are split once for each text. Null and empty texts have no words and are rejected; rows that repeat an id are
    each judged; an empty table stays empty.
    """
    order = [r for r, _, _ in ordered(df, rules, text_col, id_col, sample_rows)]
    text = F.col(f"`{text_col}`")
    return df.where(_let(words(text), lambda w: verdict(order, Measures(text, w))))
