"""Collocations against plain Python: hot phrases, many key ranges, nulls, odd characters, ties, exact large products."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import collocations as C
from lociforge.llm.collocations import collocations, pack, radix_order, runs, unpack, windows


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def expected(rows, least, top=2000, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for p in range(len(w) - k + 1):
                    f[lang, tuple(w[p : p + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for p in range(len(g) - k + 1):
                if 100 * a >= percent * found[lang, g[p : p + k]]:
                    gone.add((lang, g[p : p + k]))
    out = {}
    for (lang, g), a in found.items():
        if (lang, g) in gone:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)}


def rows_of(df):
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n):
    rng = random.Random(seed)
    voc = [chr(97 + i % 26) * (1 + i // 26) for i in range(60)] + ["É", "straße", "x\x01y", "日本", "o'k", "-", " "]
    weight = [1 / (1 + i) for i in range(len(voc))]
    passage = "New York is the BIG apple of all"
    rows = []
    for _ in range(n):
        words = rng.choices(voc, weight, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([passage, "new york", "a a a a a a a", "b,b;b:b!b?b.b"]))
        rows.append((rng.choice([" ", "\t", "  ", " , ", "\r"]).join(words), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" .\n", "fr"), ("one two " * 3000, "xx"), (passage * 2, "en"), (passage * 2, "en")]


@pytest.mark.parametrize("seed, n, least, keys", [(1, 150, 5, 50), (2, 400, 3, 100), (3, 400, 20, 10**9)])
def test_against_plain_python(spark, monkeypatch, seed, n, least, keys):
    monkeypatch.setattr(C, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(C, "RANGE_KEYS", keys)
    monkeypatch.setattr(C, "SAMPLE_EVERY", 7)
    monkeypatch.setattr(C, "SEGMENT_BYTES", 2000)
    rows = corpus(seed, n)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("word", F.lit(1)).withColumn("key", F.lit("x"))
    assert rows_of(collocations(df, least=least)) == expected(rows, least)
    assert rows_of(collocations(df, least=least, top=4, percent=60)) == expected(rows, least, 4, 60)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert rows_of(collocations(empty)) == set()
    assert rows_of(collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b c", "en")], "text string, lang string"))) == set()
    only_words = spark.createDataFrame([("a. b. " * 200, "en")], "text string, lang string")
    assert rows_of(collocations(only_words)) == set()


def test_ties_are_cut_at_top(spark):
    rows = [(f"p{i} q{i}. " * 4, "en") for i in range(30)]
    got = rows_of(collocations(spark.createDataFrame(rows, "text string, lang string"), least=4, top=7))
    assert got == expected(rows, 4, 7) and len(got) == 7


def test_products_beyond_64_bits(spark):
    big = spark.sql("select cast(3000000000007 as bigint) a, cast(90000000000011 as bigint) n, cast(3000000000008 as bigint) l, cast(3000000000009 as bigint) r")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    got = big.select(F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})").alias("s")).first().s
    assert got == 1000 * 3000000000007 * 90000000000011 // (3000000000008 * 3000000000009)


def test_keys():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, [[3], [70_000], [2], [1 << 32], [5]], (5, 3000)).astype(np.uint32)
    order = radix_order(columns)
    assert (order == np.lexsort(columns[::-1])).all()
    assert (unpack(pack(list(columns)), 3000, 5) == columns).all()
    at = columns[:, order]
    for k in range(1, 6):
        assert len(runs(at, k)) == len(np.unique(at[:k], axis=1).T)
    keys = C.binary(at)
    assert (keys[:-1] <= keys[1:]).all()


def test_windows_end_with_pieces():
    ids, begins = np.array([4, 5, 0, 6, 7, 8], np.uint32), np.array([1, 0, 0, 0, 0, 1], bool)
    assert windows(ids, begins).T.tolist() == [[4, 5, 0, 0, 0], [6, 7, 0, 0, 0]]
