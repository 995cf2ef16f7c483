"""The conditional random field over lines: marginals and slopes against enumeration, lines against str.split, held-out accuracy, edges."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociforge.llm.line_crf import Field, Lines, line_quality
from lociforge.llm.queries import fold, queries


def random_field(n, seed=1):
    rng = np.random.default_rng(seed)
    f = Field(n)
    f.p = {"w": rng.normal(size=n), "b": rng.normal(size=1), "t": rng.normal(size=(2, 2)), "s": rng.normal(size=2)}
    return f, rng


def weigh(f, x, states):
    odds = x @ f.p["w"] + f.p["b"][0]
    total = f.p["s"][states[0]]
    for k, y in enumerate(states):
        total += -np.log1p(np.exp(-odds[k])) if y else -np.log1p(np.exp(odds[k]))
        total += f.p["t"][states[k - 1], y] if k else 0
    return total


def test_marginals_against_enumeration():
    f, rng = random_field(3)
    sizes = [1, 5, 0, 2, 7, 1, 3]
    of = np.append(0, np.cumsum(sizes))
    x = rng.normal(size=(of[-1], 3))
    one, pair = f.marginals(x @ f.p["w"] + f.p["b"][0], of)
    for a, b in zip(of, of[1:], strict=False):
        if a == b:
            continue
        every = list(itertools.product((0, 1), repeat=b - a))
        p = np.exp([weigh(f, x[a:b], y) for y in every])
        p /= p.sum()
        for k in range(b - a):
            assert one[a + k, 1] == pytest.approx(sum(q for q, y in zip(p, every, strict=True) if y[k]), abs=1e-12)
            if k:
                assert pair[a + k, 0, 1] == pytest.approx(sum(q for q, y in zip(p, every, strict=True) if (y[k - 1], y[k]) == (0, 1)), abs=1e-12)
        assert not pair[a].any()


def test_slopes_against_differences():
    f, rng = random_field(3, 2)
    of = np.array([0, 4, 4, 6, 11])
    x, label = rng.normal(size=(11, 3)), rng.integers(0, 2, 11)

    def likelihood():
        total = 0.0
        for a, b in zip(of, of[1:], strict=False):
            if a < b:
                total += weigh(f, x[a:b], label[a:b]) - np.log(sum(np.exp(weigh(f, x[a:b], y)) for y in itertools.product((0, 1), repeat=int(b - a))))
        return total

    got = f.slopes(x, of, label)
    for name, p in f.p.items():
        for at in np.ndindex(p.shape):
            p[at] += 1e-5
            up = likelihood()
            p[at] -= 2e-5
            down = likelihood()
            p[at] += 1e-5
            assert got[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_long_chains_do_not_vanish():
    f, _ = random_field(1, 3)
    n = 200_001
    one, _ = f.marginals(np.tile([3.0, -3.0, 20.0], n // 3), np.array([0, n]))
    assert np.isfinite(one).all() and np.allclose(one.sum(1), 1)
    short, _ = f.marginals(np.tile([3.0, -3.0, 20.0], 40), np.array([0, 120]))
    assert np.allclose(one[:60], short[:60])


def test_lines_against_split():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é!|\n\n") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "\n", "\n\n", "x\n"]
    lines = Lines(pa.array(texts, pa.large_string()))
    want = [[len(x.encode()) for x in (t or "").split("\n")] for t in texts]
    assert np.diff(lines.of).tolist() == [len(w) for w in want]
    assert lines.size.tolist() == [x for w in want for x in w]
    shown = [(len(x.split()), x.count("|"), x in t[:k] and bool(x.split())) for t in ([s or ""][0].split("\n") for s in texts) for k, x in enumerate(t)]
    assert np.allclose(np.expm1(lines.shown[:, 1]), [c for c, _, _ in shown])
    # a line is a repeat if an earlier one has the same words
    again = [" ".join(x.split()) in [" ".join(y.split()) for y in t[:k]] and bool(x.split()) for t in ((s or "").split("\n") for s in texts) for k, x in enumerate(t)]
    assert lines.shown[:, 3].astype(bool).tolist() == again


def test_neighbours():
    lines = Lines(pa.array(["a\nB C\n!", "z"]))
    x, k = lines.features(), lines.shown.shape[1]
    assert (x[1, k : 2 * k] == lines.shown[0]).all() and (x[1, 2 * k : 3 * k] == lines.shown[2]).all()
    assert not x[0, k : 2 * k].any() and not x[3, k : 3 * k].any()
    assert x[:, -2:].tolist() == [[1, 0], [0, 0], [0, 1], [1, 1]]


def written_docs(spark):
    rng = random.Random(7)
    words = ["the", "of", "an", "house", "garden", "river", "morning", "walked", "and"]
    good = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(rng.randint(1, 9)))
    bad = lambda: "\n".join(" | ".join(rng.choice(words) + "$$$" for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 9)))
    rows = [(k, bad() if k % 4 == 0 else good(), "x") for k in range(600)]
    rows += [(None, good(), None), (600, None, None), (601, "", None), (602, " \n\n", None), (603, "\n".join([good()] * 20_000), None), (604, (good() + "\n") * 9 + bad(), None), (1, good(), None)]
    labels = [(k, int(k % 4 > 0), 0) for k in range(600)] + [(None, 1, 1), (5, None, 1), (600, 1, 0), (601, 0, 0), (602, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("label", F.lit(9)).withColumn("held", F.lit(0))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, id int").withColumn("text", F.lit("no"))


def test_edges(spark):
    docs, labels = written_docs(spark)
    got = line_quality(docs, labels, fold(5, 0)).collect()
    assert len(got) == 607 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 1}
    wrong = [k for k in range(600) if k != 1 and by[k].held_out and by[k].predicted != int(k % 4 > 0)]
    assert not wrong and by[603].predicted == 1 and by[604].predicted == 1
    assert sum(r.doc_id == 1 for r in got) == 2
    assert by[600].score == by[601].score
    empty = docs.limit(0)
    assert not line_quality(empty, labels, fold(5, 0)).collect()
    assert {r.score for r in line_quality(docs, labels.limit(0), fold(5, 0)).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = written_docs(spark)
    other = labels.withColumn("quality", F.when(fold(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in line_quality(docs, x, fold(5, 0)).where("doc_id < 600").collect()} for x in (labels, other))
    assert a == b


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op11_line_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == queries()["op11_line_quality"](spark, folder).count()
