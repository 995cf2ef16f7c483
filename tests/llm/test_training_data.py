"""Training-data operators against plain Python, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import html
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociforge.llm import decontaminate as D
from lociforge.llm.html_text import ARTICLE, NOISE, blocks, html_text, repeated
from lociforge.llm.langid import Network, language_id
from lociforge.llm.length_buckets import boundaries, length_buckets
from lociforge.llm.lm_score import END, Filter, lm_score
from lociforge.llm.near_dedup import components, near_dedup
from lociforge.llm.quality import RULES, Rule, ordered, quality_filter, quality_rules
from lociforge.llm.queries import queries
from lociforge.llm.substring_dedup import levels, substring_dedup
from lociforge.llm.token_pack import VOCABULARY, best_fit, encode, encoding, token_pack, write_packed
from lociforge.llm.toxicity import DIM, Model, toxicity
from lociforge.llm.words import ALNUM, Words, chunks, grams

RNG = random.Random(5)
VOC = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 12))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, extra int"


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOC) for _ in range(n))


def corpus():
    rng = random.Random(9)
    base, passage = [prose(rng.randint(0, 90), rng) for _ in range(30)], prose(40, rng)
    docs = base + [base[3], base[3], "", "  \n ", None, "one two", "one two", "A b", "a B"]
    docs += [f"{prose(10, rng)} {passage}\n{prose(8, rng)}" for _ in range(5)] + [prose(6000, rng), f"x {passage}"]
    for b in base[10:14]:  # near copies
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            docs.append(" ".join(v))
    rows = [(k * 3, t, "en", 0) for k, t in enumerate(docs)]
    return rows + [rows[5], (None, base[7], None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_word_kernel():
    texts = ["hello  world", "", None, "abcdefghijk lmnopqrstuvwxyzabcdefgh é\x0bü", "tail", "x", " lead trail "]
    w = Words(pa.array(texts))
    assert [w.text(k).decode() for k in range(len(w))] == [x for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    keep = np.arange(len(w)) % 2 == 0
    flat = [x for t in texts for x in words(t)]
    assert len({h for h in w.hashes()}) == len(set(flat))
    assert " ".join(w.joined(keep).to_pylist()).split() == [x for k, x in enumerate(flat) if k % 2 == 0]
    assert len(grams(w.hashes(), 5)) == len(w) - 4 and not len(grams(w.hashes()[:3], 5))
    batch = pa.record_batch([pa.array(["a" * 50, None, "b", "c" * 500, ""])], ["text"])
    assert sum(b.num_rows for b in chunks([batch], limit=20)) == 5


def test_substring_dedup(spark, docs):
    assert levels(13) == [7, 13] and levels(52) == [7, 13, 26, 52] and levels(3) == [3]
    rows = docs.collect()
    owner = {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        w = words(r.text)
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), r.doc_id)

    def expected(r):
        w = words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if r.doc_id is not None and owner[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        return r.doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), r.lang

    got = substring_dedup(docs, carry=("lang",)).collect()
    key = lambda x: str(x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(map(expected, rows), key=key)
    assert any(r.n_removed for r in got)
    assert not substring_dedup(docs.limit(0)).collect()


def test_decontamination(spark, docs):
    rows = docs.collect()
    texts = [r.text for r in rows if r.text and len(words(r.text)) > 30]
    bench = [(k, " ".join(texts[k].split()[5:35]).upper()) for k in range(4)] + [(10, "one two"), (11, "ONE, two!"), (12, ""), (13, None), (None, "a b"), (14, VOC[0])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = defaultdict(set)
    for i, t in bench:
        w = re.findall(pattern, low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))

    def expected(r):
        w, items = re.findall(pattern, low(r.text)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [True] * n
        return r.doc_id, len(w), sum(hit), sorted(items), sum(hit) > 0 and 20 * sum(hit) >= len(w)

    for size in (2 << 20, 300):
        D.BLOCK_BYTES = size
        got = D.decontaminate(docs, items, carry=("extra",)).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in got) == sorted(map(str, map(expected, rows)))
    D.BLOCK_BYTES = 2 << 20
    assert not D.decontaminate(docs.limit(0), items).collect()
    assert not any(r.contaminated for r in D.decontaminate(docs, items.limit(0)).collect())


def test_windows_are_verified_by_their_bytes():
    w = D.Windows(["1"], ["a bc de"], 13)
    words = Words(pa.array(["a bc de a bc df a b cde"]), ALNUM, lower=True)
    assert w.stand(words, np.array([0, 3, 6, 2]), np.zeros(4, int), 3).tolist() == [True, False, False, False]
    assert not len(w.stand(words, np.zeros(0, int), np.zeros(0, int), 3))


@pytest.mark.parametrize("name", ["n_words", "doc_id"])
def test_carried_columns_may_not_clash(docs, name):
    with pytest.raises(ValueError, match=name):
        substring_dedup(docs, carry=(name,))
    with pytest.raises(ValueError, match=name):
        D.decontaminate(docs, docs, item_col="doc_id", carry=(name,))


def test_clashing_columns(spark):
    """Columns of the input that are named like those an operator uses or returns change nothing."""
    rows = [(k, prose(30), "en", 0) for k in range(6)]
    plain = spark.createDataFrame(rows, SCHEMA)
    names = ("id", "text_", "w", "held", "score", "kept", "component", "n", "bucket", "shard", "row", "n_words", "hits", "items", "chunk", "segment", "doc", "at", "band", "component_id", "n_tokens")
    many = plain.select("*", *[F.lit("x").alias(c) for c in names])
    items = spark.createDataFrame([(1, rows[0][1], "z")], "item_id long, text string, item string")
    labels = plain.select("doc_id", F.lit(1).alias("toxic"), F.lit("x").alias("label"), F.lit("x").alias("id"))
    held = F.col("doc_id") == 1
    for f in (length_buckets, token_pack, substring_dedup, quality_rules, near_dedup, lambda d: D.decontaminate(d, items), lambda d: lm_score(d, held), lambda d: toxicity(d, labels, held), lambda d: language_id(d, held)):
        assert sorted(map(str, f(plain).collect())) == sorted(map(str, f(many).collect()))


def shingles(t):
    w = words(low(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dedup(spark, docs):
    rows = [r for r in docs.dropDuplicates(["doc_id"]).collect()]
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for r in near_dedup(docs).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    assert near_dedup(docs).count() == docs.count() and len({find(i) for i in sets}) < len(sets) - 5
    assert not near_dedup(docs.limit(0)).collect()


def test_near_dedup_links_beyond_stars(spark):
    """A chain: neighbours are similar, ends are not, and the smallest id is an end."""
    w = [f"w{k}" for k in range(60)]
    chain = [" ".join(w[3 * k : 3 * k + 40]) for k in range(7)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(chain)], "doc_id long, text string")
    assert len({r.component_id for r in near_dedup(df).collect()}) == 1
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A group far larger than a block, most of it linked with one member, and members that only others reach."""
    from lociforge.llm import near_dedup as N

    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(12)
    base = prose(120, rng).split()
    docs = [list(base) for _ in range(400)]
    for d in docs[1:]:
        for _ in range(rng.choice((0, 1, 1, 2))):
            d[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
    for k in range(8):  # a chain that leaves the group step by step
        docs.append([f"far{i}" for i in range(5 * (k + 1))] + base[5 * (k + 1) :])
    texts = [" ".join(d) for d in docs]
    order = rng.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(4)
    sets = [shingles(texts[k]) for k in order]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in N.near_dedup(df).collect()} == {k: find(k) for k in range(len(sets))}


def measures(t):
    w = words(t)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep, seen, dup = [False] * len(w), set(), 0
    for k in range(len(w) - 4):
        if c[tuple(w[k : k + 5])] > 1:
            rep[k : k + 5] = [True] * 5
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(rep)


def test_quality_rules(spark):
    texts = [prose(40), None, "", " ", "a b", "same line here\n" * 9 + prose(20), " ".join(f"{x}***" for x in prose(30).split()), "x y z " * 20, prose(12) + " " + prose(12) + "|", "1 2 3 4 5 6 7 8 9 10 11 12", prose(3000), "é" * 300]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 2), (None, texts[0], 3)], "doc_id long, text string, w int")
    for r in quality_rules(df).collect():
        n, chars, sym, dup, rep = measures(texts[r.doc_id or 0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.kept and r.base_failed)
    kept = [r.doc_id for r in quality_filter(df).collect()]
    assert sorted(kept, key=str) == sorted([r.doc_id for r in quality_rules(df).collect() if r.kept], key=str) and 0 in kept and 6 not in kept and 9 not in kept
    assert quality_filter(df).columns == df.columns
    assert not quality_rules(df.limit(0)).collect()


def test_words_are_split_once(spark):
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, __words string")
    for out in (quality_rules(df), quality_filter(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 2 and "Python" not in plan  # words, and lines
    long = df.withColumn("text", F.lit(prose(30)))
    assert [r["__words"] for r in quality_filter(long).collect()] == ["mine"]


def test_dear_rules_that_reject_little_come_last(spark):
    df = spark.createDataFrame([(k, prose(60)) for k in range(400)] + [(k, "x") for k in range(400, 450)], "doc_id long, text string").repartition(2).cache()
    slow = lambda m: F.size(F.filter(F.sequence(F.lit(0), F.lit(3000) + 0 * m.n_words), lambda k: F.md5(F.concat(m.text, k.cast("string"))) == "x")) > 0
    rules = (Rule("slow", slow), Rule("dear", lambda m: slow(m) | (m.n_words < 10)), *RULES)
    for _ in range(2):
        names = [(r.name, share) for r, share, _ in ordered(df, rules)]
        assert names[0][0] == "few_words" and abs(dict(names)["few_words"] - 1 / 9) < 1e-9
        assert [n for n, share in names if share > 0][-1] == "dear"
    assert [r.name for r, _, _ in ordered(df.limit(0), RULES)] and not quality_filter(df.limit(0)).collect()


def test_length_buckets(spark, docs):
    rng = random.Random(1)
    for _ in range(40):
        m, k = rng.randint(1, 8), rng.randint(1, 5)
        x, c = rng.sample(range(40), m), [rng.randint(1, 9) for _ in range(m)]
        ends, cost = boundaries(np.array(x), np.array(c), k)
        pad = lambda e: sum(n * (min(b for b in e if b >= v) - v) for v, n in zip(x, c))  # noqa: E731, B023
        best = min(pad([*q, max(x)]) for r in range(min(k, m)) for q in itertools.combinations(sorted(x)[:-1], r))
        assert len(ends) <= k and pad(ends) == best == cost
    got = length_buckets(docs, buckets=4, budget=200).collect()
    assert Counter(str(r.doc_id) for r in got) == Counter(str(r.doc_id) for r in docs.collect())
    size = {str(r.doc_id): len(words(r.text)) for r in docs.collect() if r.doc_id is not None}
    batches = defaultdict(list)
    for r in got:
        assert r.doc_id is None or r.n_tokens == size[str(r.doc_id)]
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches[r.bucket_tokens, r.batch].append(r.slot)
    assert len({b for b, _ in batches}) <= 4
    for (b, n), slots in batches.items():
        fit = max(1, 200 // max(b, 1))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= fit
        assert len(slots) == fit or (b, n + 1) not in batches
    assert not length_buckets(docs.limit(0)).collect()


def test_token_pack(spark, docs, tmp_path):
    rng = random.Random(2)
    for _ in range(30):
        size = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 60))])
        row = best_fit(size, 20)
        room, n = [], 0
        for s in sorted(size, reverse=True):
            fits = [v for v in room if v >= s]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - s)
            else:
                room.append(20 - s)
        assert row.max() + 1 == len(room) and np.bincount(row, size).max() <= 20
    texts = ["Hello world  it's a\xa0test", "", "x  y  z\n\n a b", "don't  stop ' s ’s 12 34 a1b2 \t x", " lead", "trail ", "é — ok …　 b", " "]
    ids, of = encode(pa.array(texts), VOCABULARY)
    assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == [encoding(VOCABULARY).encode_ordinary(t) for t in texts]
    pieces = defaultdict(dict)
    for r in token_pack(docs, row_length=64, shard_bytes=4000).collect():
        row, pos = np.frombuffer(r.ids, np.int32), np.frombuffer(r.positions, np.int32)
        assert len(row) <= 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(row)
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces[d].setdefault(p, []).append(row[a:b].tolist())
    for r in docs.dropDuplicates(["doc_id"]).collect():
        if r.doc_id is not None:
            whole = sum((pieces[r.doc_id][k][0] for k in sorted(pieces[r.doc_id])), [])
            assert whole == encoding(VOCABULARY).encode_ordinary(r.text or "") + [50256]
    assert not token_pack(docs.limit(0)).collect()
    packed = token_pack(docs, row_length=64, shard_bytes=4000)
    write_packed(packed, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert sorted(map(str, back.select(packed.columns).collect())) == sorted(map(str, packed.collect())) and not list(tmp_path.glob("packed/shard=*"))


def test_lm_score(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = docs.withColumn("h", held).collect()
    tokens = {r: words(low(r.text)) + [END] for r in rows}
    c = Counter(t for r in rows if r.h is False for t in tokens[r])
    n, v = sum(c.values()), len(c)
    got = lm_score(docs, held).collect()
    assert len(got) == len(rows)

    def expected(r):
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens[r])
        return r.doc_id, r.h, len(tokens[r]), sum(c[t] > 0 for t in tokens[r]), n, round(base, 6)

    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == sorted(str(expected(r)) for r in rows)
    assert all(r.score < 0 for r in got)
    assert sum(r.score > r.base_score for r in got if not r.held_out and r.n_tokens > 5) > len(got) / 2
    assert not lm_score(docs.limit(0), held).collect()


def test_filter_counts():
    table = Filter(np.full(1 << 10, 0, np.uint8), 4, 2048)
    assert table.counts(np.arange(5, dtype=np.uint64), np.uint64(1)).tolist() == [0] * 5


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["gronk" + x for x in ("", "er", "ing", "ed", "le", "ish", "y", "al")]
    rows, labels = [], []
    for k in range(700):
        y = int(k % 3 == 0)
        w = prose(25, rng).split()
        if y:
            w[rng.randrange(25)] = rng.choice(bad[:6] if k < 500 else bad)
        rows.append((k, " ".join(w), "en", 0))
        labels.append((k, y))
    df = spark.createDataFrame([*rows, (9000, None, None, 0), (9001, "", None, 0), (None, "gronk", None, 0)], SCHEMA)
    got = {r.doc_id: r for r in toxicity(df, spark.createDataFrame([*labels, (9000, 1), (None, 1), (3, None)], "doc_id long, toxic int"), F.col("doc_id") >= 500).collect()}
    test = [(got[k], y) for k, y in labels if k >= 500]
    assert np.mean([r.predicted == y for r, y in test]) > 0.95
    assert got[9000].score == 0 == got[9001].score and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(False)).collect()
    assert len(none) == df.count() and not any(r.predicted for r in none)
    # scores do not grow with the number of harmless words, or of repeated ones
    many = spark.createDataFrame([(1, " ".join(f"h{k}x" for k in range(3000))), (2, "h1x " * 50_000), (2, "h1x"), (None, "gronk")], "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(many.withColumn("doc_id", F.col("doc_id") + 20_000))
    late = [r for r in toxicity(both, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") >= 500).collect() if r.doc_id is None or r.doc_id > 20_000]
    assert len(late) == 5 and not any(r.predicted for r in late if r.doc_id) and len({r.score for r in late if r.doc_id == 20_002}) == 1
    assert all(r.held_out is False for r in late if r.doc_id is None)
    assert not toxicity(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()


def slopes(value, at, f, step=1e-3):
    """Slope of f() by value[at], by differences."""
    old = value[at]
    value[at] = old + step
    a = f()
    value[at] = old - step
    b = f()
    value[at] = old
    return (a - b) / (2 * step)


def test_gradient_of_the_network():
    import lociforge.llm.langid as lang

    net = Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.array([[32, 97, 98, 32, 99], [32, 99, 32, 97, 32]], np.uint8).T
    y, here = np.array([0, 2]), np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]])

    def loss():
        p = net.labels(net.states(x))
        return -(np.log(p[:, y, [0, 1]]) * here).sum() / here.sum()

    g = net.gradient(x, y, here)
    for k, at in (("x", (3, 97)), ("x", (30, 256 + 99)), ("u", (0, lang.HIDDEN + 2, 1)), ("u", (1, 2 * lang.HIDDEN + 1, 0)), ("u", (0, 0, 3)), ("o", (1, 2, 1)), ("o", (0, 0, 4)), ("oc", (1, 0)), ("c", (1, 4, 0))):
        assert abs(slopes(net.p[k], at, loss) - g[k][at]) < 1e-5


def test_network_reads_across_words_and_windows(monkeypatch):
    """Windows give what one pass over the whole text gives, but for what lies more than CONTEXT bytes back."""
    import lociforge.llm.langid as lang

    net = Network(2)
    texts = [prose(400).encode(), b"", "é".encode(), prose(3).encode()]
    data, rows = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    got = net.totals(data, rows)
    for k, t in enumerate(texts):
        want = net.labels(net.states(np.frombuffer(b" " * 20 + t + b" " * 20, np.uint8)[:, None]))[20 : 20 + len(t), :, 0].sum(0)
        assert np.allclose(got[k], want, rtol=5e-3, atol=1e-6)
    word = lambda before: net.labels(net.states(np.frombuffer(before + b" word", np.uint8)[:, None]))[-4:, :, 0]
    assert abs(word(b"zz") - word(b"qq")).max() > 1e-6
    monkeypatch.setattr(lang, "WIDTH", 3)
    assert np.allclose(net.totals(data, rows), got)


def test_gradient_of_the_word_bags():
    model = Model()
    model.p["v"] = np.random.default_rng(1).normal(0, 0.5, DIM)
    x = np.random.default_rng(2).normal(0, 1, (4, DIM))
    doc, word, label = np.array([0, 0, 1, 1, 1, 2]), np.array([0, 1, 1, 2, 3, 3]), np.array([1, 0, 1])
    loss = lambda: model.gradient(x, doc, word, label)[0]
    _, dx, g = model.gradient(x, doc, word, label)
    assert all(abs(slopes(x, at, loss) - dx[at]) < 1e-5 for at in ((0, 1), (1, 3), (3, 0)))
    assert all(abs(slopes(model.p[k], at, loss) - g[k][at]) < 1e-5 for k, at in (("w", (2, 1)), ("w", (1, 0)), ("v", (3,)), ("b", (1,)), ("b", (0,))))


def parquet(spark, name, folder="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_toxicity_held_out(spark):
    """Labels are noisy: some toxic rows have nothing toxic in them."""
    got = queries()["op7_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(parquet(spark, "labels", "/root/testdata/sf0.1"), "doc_id").where("toxic is not null").collect()
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.8 and np.mean([r.predicted for r in got if not r.toxic]) < 0.002


def test_language_id_held_out(spark):
    got = queries()["op8_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(parquet(spark, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"xx": ["ka", "ro", "ti", "mu"], "yy": ["sche", "ung", "ber", "lich"]}
    text = lambda v: " ".join("".join(rng.choice(syllables[v]) for _ in range(rng.randint(1, 4))) for _ in range(12))
    rows = [(k, text(v), v, 0) for k in range(200) for v in [("xx", "yy")[k % 2]]]
    df = spark.createDataFrame([*rows, (900, None, "xx", 0), (901, "12 34 !", "yy", 0), (902, text("xx"), None, 0), (None, text("yy"), "yy", 0), (903, "a" * 500_000, "xx", 0), (904, text("yy"), "yy", 0), (904, text("yy"), "yy", 1)], SCHEMA)
    rows_of = language_id(df, F.col("doc_id") >= 100).collect()
    got = {r.doc_id: r for r in rows_of}
    assert len(rows_of) == df.count() and got[None].held_out is False and [r.lang_pred for r in rows_of if r.doc_id == 904] == ["yy"] * 2
    assert not language_id(df.limit(0), F.lit(False)).collect()
    assert np.mean([got[k].lang_pred == v for k, _, v, _ in rows if k >= 100]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == "und" for r in language_id(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect())


def test_blocks():
    page = "<body class='x sidebar'><div id=nav><a>Home</a></div><article><h1>T &amp; t</h1><p class=ad>buy<p>real <b>wor</b>ld<br>x <script>a<b</script>y<ul><li>a<li>b</ul><section class=comments><p>c</section></article><footer>z"
    got = blocks(page)
    assert [t for r, t in got if r == ARTICLE] == ["T & t", "real world x y", "a", "b"]
    assert [t for r, t in got if r == NOISE] == ["Home", "buy", "c", "z"]
    assert blocks(None) == [] == blocks("") and blocks("<p>cut &amp") == [(1, "cut &")] and blocks("<article><p>a <a href='x") == [(ARTICLE, "a")]
    # names count as whole tokens, or in compounds with known companions
    for name, kept in (("social-studies", 1), ("article-header", 1), ("notice-board", 1), ("ad", 0), ("ad-2", 0), ("siteFooter", 0), ("cookie_notice", 0), ("x sidebar-left", 0), ("adverb", 1)):
        assert [t for r, t in blocks(f"<article><p>a<div class='{name}'>b</div></article>") if r == ARTICLE] == ["a", "b"][: 1 + kept], name
    assert [t for _, t in blocks("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table><dl><dt>f<dd>g<dt>h</dl><ul><li>i<ul><li>j</ul>k<li>l</ul><p>m<p>n<b>o<div>p</div></b>q")] == [*"abcdefghijklm", "n o".replace(" ", ""), "p", "q"]
    tokens = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, -1, 20, 1, 2, 3, 4, 5, 6, 7, 8, 21, -2])
    assert repeated(tokens, np.array([0] * 10 + [1] * 11)).nonzero()[0].tolist() == [*range(8), *range(11, 19)]
    assert not repeated(tokens, np.zeros(21, int)).any()


@pytest.mark.parametrize("page", ["<div>" * 400_000, "<b>" * 300_000 + "<hr>" * 200_000, "<li>" + "<table>" + "<div>" * 100_000 + "<li></li>" * 100_000, "<div><p>" * 150_000 + "</span>" * 100_000, "<b>" * 200_000 + "</b></p>" * 100_000])
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    blocks(page + "end")
    assert time.perf_counter() - began < 8


def test_html_edges(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(None, "http://a/1", "<article>x</article>", "z"), (1, None, "<article>x &lt; y</article>", None), (1, "http://a/1", "<div>own text</div>", None), (1, "http://a/1", "<div>own text</div>", None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(str((r.page_id, r.text)) for r in html_text(df).collect()) == ["(1, 'own text')", "(1, 'own text')", "(1, 'x < y')", "(None, 'x')"]
    assert sorted(r.text for r in html_text(df.limit(2)).collect()) == ["x", "x < y"] and not html_text(df.limit(0)).collect()


def test_html_given_pages(spark):
    """On given pages the text is that of the article's blocks, cut out by plain string handling."""
    pages = parquet(spark, "pages", "/root/testdata/sf0.001").collect()
    got = {r.page_id: r.text for r in html_text(parquet(spark, "pages", "/root/testdata/sf0.001")).collect()}
    for r in pages:
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        body = re.sub("<(?:div|section|aside)[^>]*class=.*?</(?:div|section|aside)>|<script.*?</script>|<!--.*?-->", "", body, flags=re.S)
        parts = [html.unescape(re.sub("<[^>]*>", " " if "<br" in x else "", x.replace("<br>", " "))) for x in re.split("</?(?:p|h1|h2|h3|ul|li|ol|div|table|tr|td|blockquote|pre)\\b[^>]*>", body)]
        assert got[r.page_id] == "\n\n".join(" ".join(x.split()) for x in parts if x.strip())
    assert len(got) == len(pages)


def test_html_text(spark):
    rng = random.Random(6)
    menu = "<div class=top>Start here to see all of our many fine pages</div>"
    bodies = [prose(30, rng) for _ in range(6)]
    rows = [(k, f"http://h.example/{k}", f"<html><body>{menu}<div>{b}</div><div>{bodies[0]}</div></body></html>") for k, b in enumerate(bodies)]
    rows += [(50, "http://h.example/a", f"{menu}<article><p>{bodies[0]}</p></article>"), (51, None, None), (52, "x", ""), (53, "http://h.example/0", rows[0][2])]
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[51] == got[52] == ""
    for k in range(1, 6):  # the shared run is gone, the unique one stays
        assert got[k] == bodies[k]
    assert got[50] == bodies[0]


def brute_pipeline(rows, items):
    """(doc_id, text) of what the stages before packing keep, in plain Python."""
    kept = []
    for i, t in rows:
        n, chars, sym, dup, rep = measures(t)
        lines = sum(bool(words(x)) for x in (t or "").split("\n"))
        letters = sum(any(c.isalpha() for c in w) for w in words(t))
        if not (n < 10 or 100 * rep > 20 * n or 2 * sym > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 15 * n or 2 * letters < n):
            kept.append((i, t))
    sets = {i: shingles(t) for i, t in kept if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    kept = [(i, t) for i, t in kept if i is None or find(i) == i]
    owner = {}
    for i, t in sorted((x for x in kept if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), i)
    out = []
    windows = {tuple(w[k : k + min(13, len(w))]) for w in (re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t)) for t in items) for k in range(len(w) - min(13, len(w)) + 1)}
    for i, t in kept:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and owner[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        w = [x for x, g in zip(w, gone) if not g]
        v = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(" ".join(w)))
        hit = [False] * len(v)
        for k in range(len(v) - 12):
            if tuple(v[k : k + 13]) in windows:
                hit[k : k + 13] = [True] * 13
        if not (sum(hit) and 20 * sum(hit) >= len(v)):
            out.append((i, " ".join(w)))
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(r[0], r[1], r[2], "s", len(r[1] or "")) for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    long = [r for r in rows if r[0] is not None and r[1] and len(r[1].split()) > 60]
    items = [" ".join(r[1].split()[10:40]) for r in (long[0], long[-1])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(str, brute_pipeline([r[:2] for r in rows], items)))
    sizes = [len(rows)]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        sizes.append(docs.count())
        assert tuple(docs.columns) == P.COLUMNS
    assert sorted(str((r.doc_id, r.text)) for r in docs.collect()) == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 10
    packed = P.run(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in packed) == sorted(str((r.doc_id, len(words(r.text)))) for r in docs.collect())


@pytest.mark.parametrize("part", ["documents", "benchmark"])
def test_pipeline_of_an_empty_table(spark, tmp_path, part):
    import corpus_pipeline as P

    rows = [(k, prose(30 + k), "en", "s", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, "nothing of these")], "item_id long, text string")
    (docs.limit(0) if part == "documents" else docs).write.parquet(f"{tmp_path}/documents.parquet")
    (items.limit(0) if part == "benchmark" else items).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == (0 if part == "documents" else 5)


def test_hash_of_kept_text(spark, docs):
    r = substring_dedup(docs).select("kept_text", F.sha2("kept_text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.kept_text.encode()).hexdigest()


def test_alnum_words():
    assert [Words(pa.array(["A-b ü9"]), ALNUM, lower=True).text(k).decode() for k in range(3)] == ["a", "b", "ü9"]
