"""The suffix array over a host's pages, and what it decides."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lociforge.llm import html_text as M

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in M.html_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_names_by_doubling():
    run = np.arange(1, 60)
    left = np.append(np.arange(40, 0, -1), np.arange(19, 0, -1))  # chains of 47 and of 26 tokens
    names, count = M.doubled(run, left)
    assert count.tolist() == [1 + (n + 7 >= 16) + (n + 7 >= 32) for n in left] and (names[:, 0] == run).all()
    again, _ = M.doubled(np.append(run[:40], run[:19]), left)
    assert (again[40:42, 1] == again[:2, 1]).all() and len(np.unique(names[:, 1][count > 1])) == (count > 1).sum()


@pytest.mark.parametrize("seed", range(5))
def test_longest_repeats(seed):
    """Against all pairs of suffixes."""
    rng = random.Random(seed)
    found = {}
    for _ in range(300):
        key = tuple(rng.choice([1, 2]) for _ in range(rng.randint(1, 6)))
        page = rng.randrange(40)
        low, high = found.get(key, (page, page))
        found[key] = min(low, page), max(high, page)
    keys = sorted(found)
    names = np.zeros((len(keys), 6), np.int64)
    for i, key in enumerate(keys):
        names[i, : len(key)] = key
    low, high = np.array([found[k] for k in keys]).T
    want = []
    for key in keys:
        shared = [n for n in range(1, len(key) + 1) if len({p for k in keys if k[:n] == key[:n] for p in found[k]}) > 1]
        want.append(M.RUN << max(shared) - 1 if shared else 0)
    assert M.longest_repeats(names, np.array([len(k) for k in keys]), low, high).tolist() == want


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_any_length(spark, seed):
    """200 pages of three hosts that share substrings of 1 to 300 tokens, against a comparison of all their runs."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(4000)]
    shared = [[rng.choice(pool) for _ in range(n)] for n in (1, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 300)]
    rows = []
    for k in range(200):
        blocks = []
        for _ in range(rng.randint(0, 6)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            blocks.append([rng.choice(pool) for _ in range(rng.randint(0, 20))] + part[a : rng.randint(a, len(part))] + [rng.choice(pool) for _ in range(rng.randint(0, 3))])
        rows.append((k, f"http://h{k % 3}.example/{k}", [" ".join(x) for x in blocks if x]))
    rows.append((200, "http://h0.example/copy", rows[0][2]))
    owners = {}
    for k, url, blocks in rows:
        words = " ".join(blocks).split()
        for i in range(len(words) - M.RUN + 1):
            owners.setdefault((url[:17], *words[i : i + M.RUN]), set()).add(tuple(blocks))
    got = texts(spark, [(k, url, "".join(f"<p>{x}</p>" for x in blocks)) for k, url, blocks in rows])
    for k, url, blocks in rows:
        words = " ".join(blocks).split()
        covered = [False] * len(words)
        for i in range(len(words) - M.RUN + 1):
            if len(owners[url[:17], *words[i : i + M.RUN]]) > 1:
                covered[i : i + M.RUN] = [True] * M.RUN
        kept, at = [], 0
        for x in blocks:
            n = len(x.split())
            if sum(covered[at : at + n]) < M.COVERED * n:
                kept.append(x)
            at += n
        assert got[k] == "\n\n".join(kept), k


def test_repeats_decide_inside_articles(spark):
    """An element that markup leaves open loses what other pages have; its unique text stays, and so does the article's own."""
    words = lambda *key: " ".join(f"{'x'.join(map(str, key))}y{k}" for k in range(12))
    page = lambda k, name, body: f"<article><h1>{words('title')}</h1><p>{words('own', k)}</p><div class='{name}'><p>{body}</p></div><p>{words('line')}</p></article>"
    keep = lambda k, *more: "\n\n".join([words("title"), words("own", k), *more, words("line")])
    rows = [(k, f"http://h.example/{k}", page(k, "related-stories", words("more"))) for k in range(4)]
    rows += [(k, f"http://h.example/{k}", page(k, "related-stories", words("only", k))) for k in (4, 5)]
    rows += [(k, f"http://h.example/{k}", page(k, "story-part", words("part"))) for k in (6, 7)]
    rows.append((8, "http://other.example/", rows[0][2]))
    rows += [(k, f"http://h.example/{k}", f"<article><div class='related-stories'>{words('copy')}<hr>{k}</div></article>") for k in (9, 10)]
    rows.append((11, "http://h.example/11", f"<article>see <b class='related-stories'>{words('more')}</b> {' '.join(f'z{k}' for k in range(20))}</article>"))
    rows += [(k, f"http://h.example/{k}", f"<div>{k}</div><article><div class='related-stories'>{words('all')}</div></article>") for k in (12, 13)]
    got = texts(spark, rows)
    assert got[12] == got[13] == words("all")
    assert [got[k] for k in range(4)] == [keep(k) for k in range(4)]
    assert [got[k] for k in (4, 5)] == [keep(k, words("only", k)) for k in (4, 5)] and [got[k] for k in (6, 7)] == [keep(k, words("part")) for k in (6, 7)]
    assert got[8] == keep(0, words("more"))
    assert [got[k] for k in (9, 10)] == ["9", "10"]
    assert got[11] == f"see {words('more')} {' '.join(f'z{k}' for k in range(20))}"


def test_all_rows_come_by_the_array(spark, monkeypatch):
    """Pages with articles, too: what the array finds reaches each row."""
    seen = []
    kept = M.written
    monkeypatch.setattr(M, "written", lambda df, *a: seen.append(kept(df, *a)) or seen[-1])
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = M.html_text(pages)
    streams, suffixes, gone = seen
    assert out.count() == streams.count() == pages.count() and "Join" in out._jdf.queryExecution().toString()
    assert suffixes.where("low < high").count() and gone.count()


def test_copies_are_one_page(spark):
    """The same text in other markup is no second page; the same text outside of other articles is one."""
    words = lambda *key: " ".join(f"{'x'.join(map(str, key))}y{k}" for k in range(12))
    rows = [(0, "http://h.example/0", f"<div>{words('a')}</div>"), (1, "http://h.example/1", f"<main><p>{words('a')}</p></main>"), (2, "http://h.example/2", f"<div>{words('a')}</div>")]
    rows += [(k, "http://h.example/", f"<article>{k} <div class='related-stories'>{words('b')}</div></article>") for k in (3, 4)]
    assert texts(spark, rows) == {0: words("a"), 1: words("a"), 2: words("a"), 3: "3", 4: "4"}


def test_texts_are_kept_once(spark, monkeypatch, tmp_path):
    """Shuffles and tables of one run together are less than 1.5 times the pages: texts wait in a table, in buckets, for their verdicts."""
    seen = []
    kept = M.written
    monkeypatch.setattr(M, "written", lambda df, *a: seen.append(kept(df, *a)) or seen[-1])

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    pages = Path("/root/testdata/sf0.1/pages.parquet")
    before = shuffled()
    out = M.html_text(spark.read.parquet(str(pages)))
    out.write.parquet(f"{tmp_path}/out")
    tables = {Path(f.removeprefix("file:")).parent for df in seen for f in df.inputFiles()}
    written = sum(f.stat().st_size for t in tables for f in t.glob("*.parquet"))
    assert len(tables) == 3 and written > 0
    assert written + shuffled() - before < 1.5 * pages.stat().st_size
    assert "Bucketed: true" in out._jdf.queryExecution().toString() and not [t for t in spark.catalog.listTables() if t.name.startswith("lociforge_")]


def test_places_in_chunks(monkeypatch):
    """Every page has its own place in its chunk; a chunk ends at so many characters of streams, or pages."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())])
    rows = [(k, "", ("<p>" + "x " * 400 if k < 30 else ""), "") for k in range(200)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a : a + 10]], schema) for a in range(0, 200, 10)]
    monkeypatch.setattr(M, "CHUNK_BYTES", 9000)
    got = pa.Table.from_batches(list(M._streams(iter(batches))))
    places = {}
    for page_id, chunk, at in zip(*(got.column(c).to_pylist() for c in ("page_id", "chunk", "at")), strict=True):
        places.setdefault(chunk, []).append((page_id, at))
    assert [[p for p, _ in x] for x in places.values()] == [[*range(20)], [*range(20, 30), *range(30, 40)], [*range(40, 130)], [*range(130, 200)]]
    assert all([a for _, a in x] == [*range(len(x))] for x in places.values())


def test_verdicts_of_copies_and_of_many_chunks(spark):
    """Each row takes the verdict of its own place: copies, null ids and empty pages between others, in one chunk and in many."""
    words = lambda *key: " ".join(f"{'x'.join(map(str, key))}y{k}" for k in range(12))
    rows, want = [], []
    for k in range(300):
        html = "" if k % 7 == 0 else f"<div>{words('menu', k % 3)}</div><article>{words('own', k % 50)}<div class='related-stories'><p>{words('more', k % 2)}<p>{words('only', k % 50)}</div></article>"
        rows.append((None if k % 11 == 0 else k, f"http://h.example/{k}", html))
        want.append((rows[-1][0], rows[-1][1], "" if k % 7 == 0 else f"{words('own', k % 50)}\n\n{words('more', k % 2)}\n\n{words('only', k % 50)}"))
    # what more than one text has goes; own and only lie on copies with other menus, which are other pages
    want = [(p, u, t and t.split("\n\n")[0]) for p, u, t in want]
    for n in (1, 13):
        got = M.html_text(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()
        assert sorted((r.url, str(r.page_id), r.text) for r in got) == sorted((u, str(p), t) for p, u, t in want)
