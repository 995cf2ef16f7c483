"""The filter as a model: what its kept slices say of texts, against what the corpus' own run and exact counts say."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lociforge.llm import lm_score as M

HELD = "doc_id % 5 = 0"


def corpus(n):
    rng = random.Random(n)
    return [(k, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize(("n", "each"), [(100, 1 << 20), (1000, 20_000), (6000, 20_000)])
def test_kept_slices_score_unseen_texts(spark, monkeypatch, n, each):
    """Few segments and many: texts get the scores that they have in the corpus' own run, and errors of the filter do not grow."""
    monkeypatch.setattr(M, "SEGMENT_BYTES", each)
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = M.learn(df, F.expr(HELD))
    own = {r.id: r for r in learned.own().where("held").collect()}
    got = {r.doc_id: r for r in learned.score(df.where(HELD)).collect()}
    assert set(got) == set(own) and all(got[k].n_tokens == own[k].n_tokens and got[k].score == pytest.approx(own[k].score, rel=1e-12) for k in own)
    assert learned.slices().count() <= learned.n_segments
    unknown, missed = (sum(r.n_tokens - r.n_known for r in x.values()) for x in (own, got))
    assert 0.97 * unknown <= missed <= unknown and unknown >= 20  # enough to tell


def test_more_questions_than_a_slice_takes(spark, monkeypatch):
    """A small corpus, and ten times as much text to score: slices are copied, scores stay the same."""
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = M.learn(df, F.lit(False))
    many = spark.createDataFrame([(k + 1000 * j, t) for k, t in rows for j in range(10)], "doc_id long, text string").repartition(7)
    once = {r.doc_id: r.score for r in learned.score(many).collect()}
    monkeypatch.setattr(M, "SEGMENT_BYTES", 500)
    again = {r.doc_id: r.score for r in learned.score(many).collect()}
    assert once == pytest.approx(again, rel=1e-12) and len(once) == 600
    assert all(once[k + 1000 * j] == pytest.approx(once[k], rel=1e-12) for k, _ in rows for j in range(10))


def test_odd_texts(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, nothing learned, nothing to score."""
    long = "word " * 900_000
    texts = [(1, None), (2, ""), (3, "word word"), (3, "word word"), (None, "other"), (4, long)]
    df = spark.createDataFrame([(*x, 0, b"") for x in texts], "doc_id long, text string, chunk int, slice binary")
    learned = M.learn(df, F.col("doc_id") == 3)
    got = learned.score(df).collect()
    assert sorted((r.n_tokens for r in got)) == [1, 1, 2, 3, 3, 900_001] and got[0].asDict().keys() == {"doc_id", "n_tokens", "n_known", "score"}
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[4].n_known == 900_001 and len(re.findall(r"\S+", long)) == 900_000
    assert learned.score(df.limit(0)).count() == 0
    nothing = M.learn(df.limit(0), F.lit(False))
    assert nothing.slices().count() == 0 and {r.score for r in nothing.score(df).collect()} == {0.0}
