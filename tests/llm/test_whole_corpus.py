"""What must hold at every size: no cap on what is gathered, no group of which only a part is looked at."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import lm_score as M


@pytest.mark.parametrize("n", [1000, 30_000, 1_000_000])
def test_filter_errors_do_not_grow(n):
    rng = np.random.default_rng(n)
    keys, unseen = rng.integers(0, 1 << 63, (2, n), np.uint64)
    counts = rng.geometric(0.3, n)
    table = M.slice_filter((keys, counts, M._WORD), (keys[:0], counts[:0], M._PAIR))
    steps = 1 + np.floor(np.log(counts) / math.log(M.BASE) + 1e-9)
    assert (table.levels(keys, M._WORD) >= steps).all()
    assert (table.levels(keys, M._WORD) > steps).mean() < 0.03 and (table.levels(unseen, M._WORD) > 0).mean() < 0.03


def test_lm_score_against_exact_counts(spark, monkeypatch):
    """Nothing that grows with the corpus goes to every worker, and scores are those of quantised counts but for few errors."""
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the filter was broadcast"))
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 40)))) for k in range(3000)]
    got = {r.doc_id: r for r in M.lm_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 7 == 2).collect()}
    tokens = {k: [*re.findall(r"\S+", t), None] for k, t in rows}
    train = [k for k, _ in rows if k % 7 != 2]
    one, two = Counter(t for k in train for t in tokens[k]), Counter(p for k in train for p in zip([None, *tokens[k]], tokens[k]))
    total = sum(one.values()) + len(one) + 1
    middle = lambda c: float(M.middles(np.array([1 + math.floor(math.log(c) / math.log(M.BASE) + 1e-9) if c else 0]))[0])

    def exact(k):
        out = 0.0
        for u, w in zip([None, *tokens[k]], tokens[k]):
            before, both = middle(one[u]), middle(two[u, w])
            out += math.log10((min(both, before) + M.WEIGHT * (middle(one[w]) + 1) / total) / (before + M.WEIGHT))
        return out

    off = np.array([abs(got[k].score - exact(k)) / len(tokens[k]) for k, _ in rows])
    assert len(got) == len(rows) and np.median(off) < 1e-3 and off.mean() < 0.02


@pytest.mark.parametrize("n", [1000, 1001, 2400])
def test_html_repeats_over_a_whole_host(spark, n):
    """A block that two pages of a host share is boilerplate, however many pages the host has."""
    from lociforge.llm.html_text import html_text

    words = lambda *key: " ".join(f"{'x'.join(map(str, key))}y{k}" for k in range(12))
    rows = [(k, f"http://h.example/{k}", f"<div>{words('shared', k % (n // 2))}</div><div>{words('own', k)}</div>") for k in range(n)]
    rows.append((n, "http://other.example/", rows[0][2]))
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == n + 1 and all(got[k] == words("own", k) for k in range(n))
    assert got[n] == f"{words('shared', 0)}\n\n{words('own', 0)}"


def test_intermediate_tables(spark, tmp_path, monkeypatch):
    """They lie in the shared folder, and can be deleted; a cluster without such a folder is an error."""
    from types import SimpleNamespace

    from lociforge.llm import store

    monkeypatch.setattr(store, "shared_folder", lambda _: f"file://{tmp_path}")
    assert store.written(spark.range(3)).count() == 3 and list(tmp_path.glob("tables/*/*"))
    store.clear_tables(spark)
    assert not list(tmp_path.glob("tables/*/*"))
    monkeypatch.undo()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(cluster)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    """Each member that stands apart meets all others; those of the largest component do not meet each other."""
    from lociforge.llm import near_dedup as N

    members = spark.createDataFrame([(7, k, int(k < 30)) for k in range(40)], "band long, id long, component long")
    monkeypatch.setattr(N, "BLOCK", 4)
    blocks = N._in_pairs(members, "band")
    pairs = {}
    for r in blocks.collect():
        pairs.setdefault((r.i, r.j), []).append(r)
    met = {(a.id, b.id) for (i, j), rows in pairs.items() for a in rows if a.part == i for b in rows if b.part == j}
    assert all((a, b) in met or (b, a) in met for a in range(30, 40) for b in range(30))
    parts = {r.id: r.part for r in blocks.collect()}
    assert not any(parts[a] != parts[b] for a, b in met if a < 30 and b < 30)


@pytest.mark.parametrize("percent", [75, 60])
def test_small_sets_share_a_key(spark, percent):
    """Every two similar sets, one of them of fewer than FEW shingles, have one of their rarest shingles in common."""
    from lociforge.llm import near_dedup as N

    rng = random.Random(percent)
    sets = [set(rng.sample(range(60), rng.randint(1, 9))) for _ in range(60)]
    for _ in range(240):
        x = set(rng.choice(sets)) | {rng.randrange(10**6) for _ in range(rng.choice((0, 1, 1, 2, 9)))}
        x -= set(rng.sample(sorted(x), rng.choice((0, 1)) if len(x) > 1 else 0))
        if len(x) <= 100 * (N.FEW - 1) // percent:
            sets.append(x)
    rows = [(bytes([k % 256, k // 256]), k, sorted(x)) for k, x in enumerate(sets)]
    keys = {}
    for r in N.rarest(spark.createDataFrame([*rows, (b"none", 10**6, None)], "class binary, id long, few array<long>"), percent).collect():
        keys.setdefault(r.id, set()).add(r.band)
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(similar) > 50 and all(keys[a] & keys[b] for a, b in similar)
    assert sum(map(len, keys.values())) < sum(map(len, sets)) / 1.5
    assert N.least_equal(75) == 70 and N.least_equal(1) == 0


def test_links_of_short_texts(spark):
    """Texts of five to twelve words that differ in a word at one end, or share most words by chance, against brute force."""
    from lociforge.llm import near_dedup as N

    rng = random.Random(8)
    texts = []
    for k in range(150):
        w = [rng.choice("abcd") for _ in range(rng.randint(5, 12))]
        texts += [" ".join(w), " ".join([*w, f"x{k}"]), " ".join(w[1:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in split]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in N.near_dedup(df).collect()} == {k: find(k) for k in range(len(sets))}
    assert len({find(k) for k in range(len(sets))}) < len(sets)
