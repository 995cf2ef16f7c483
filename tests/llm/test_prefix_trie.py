"""The prefix trie against plain Python: copies, empty and long conversations, nulls, ties, many partitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm.prefix_trie import common, lcps, prefix_trie, turn_arrays
from lociforge.llm.queries import spliced

SCHEMA = "conv_id long, turn long, role string, text string, key int, id string"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def sequences(rows):
    """Turns of each conversation in order: (role, text)."""
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def splice(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        own = (len(members[k]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[x] for x in kids[k])
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(set(got)) == len(got)
    return set(got)


def talks(seed, n, copies):
    rng = random.Random(seed)
    said = [("user", "hello there"), ("assistant", "hi"), ("user", ""), (None, "hi"), ("user", None), ("assistant", "one  two\tthree\nfour é"), ("", "x" * 5000)]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c * 3 - 7, t if rng.random() < 0.95 else None, *rng.choice(said[: 2 + t]), t, "e"))
    for c in range(copies):  # one large group of copies, longer than a partition
        rows += [(10_000 + c, 0, "user", "hello there", 0, ""), (10_000 + c, 1, "assistant", "hi", 0, "")]
    rows += [(20_000, t, "user", f"turn {t}", 0, "") for t in range(300)] + [(20_001, t, "user", f"turn {t}", 0, "") for t in range(299)]
    return rows + rows[:9] + [(None, 1, "user", "lost", None, None), (30_000, None, None, None, None, None)]


@pytest.mark.parametrize("seed, n, copies, each", [(1, 60, 40, 30), (2, 200, 150, 50), (3, 5, 0, 10), (4, 30, 300, 1000)])
def test_against_plain_python(spark, seed, n, copies, each):
    rows = talks(seed, n, copies)
    arrays = turn_arrays(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert rows_of(prefix_trie(arrays, each)) == trie(sequences(rows))
    assert rows_of(prefix_trie(spliced(arrays), each)) == trie(splice(sequences(rows)))


def test_turnless_conversations(spark):
    rows = [(c, t, "user", f"t{t}", 0, "") for c in range(1, 50) if c % 20 for t in range(2)]  # no conversation to begin with
    built = splice(sequences(rows))
    assert any(not s for s in built.values())
    assert rows_of(prefix_trie(spliced(turn_arrays(spark.createDataFrame(rows, SCHEMA))), 7)) == trie(built)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(prefix_trie(spliced(turn_arrays(empty)))) == set()


def test_other_names(spark):
    rows = [(1, 0, "a", "b c"), (2, 0, "a", "b c"), (2, 1, "z", "w")]
    df = spark.createDataFrame(rows, "key long, parent long, first string, nodes string").withColumn("conv_id", F.lit(3)).withColumn("turns", F.lit("x"))
    assert rows_of(prefix_trie(turn_arrays(df, "key", "parent", "first", "nodes"))) == trie(sequences(rows))


def test_ties_are_ordered_by_digest(spark):
    rows = [(1, 5, "u", t) for t in "abcd"] + [(2, 5, "u", t) for t in "dcba"]
    got = rows_of(prefix_trie(turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert max(x[1] for x in got) == 4 and all(x[3] == 2 for x in got)


def test_lcps():
    rng = random.Random(3)
    keys = sorted(b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(7))) for _ in range(200))
    of = np.append(0, np.cumsum([len(k) // 16 for k in keys]))
    data = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    want = [next((i for i in range(min(len(a), len(b)) // 16) if a[16 * i] != b[16 * i]), min(len(a), len(b)) // 16) for a, b in zip(keys, keys[1:], strict=False)]
    assert lcps(data, of).tolist() == want == [common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
