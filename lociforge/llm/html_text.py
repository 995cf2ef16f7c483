"""Main text of web pages: markup structure, and a suffix array over each host's pages for what structure leaves open.

Every page is cut into blocks. Markup that names its role decides first: scripts, menus, headers, footers, sidebars,
notices, adverts, forms and comments are boilerplate, and what an article element holds apart from these is the text.
All the rest is a token stream: what lies outside of articles, and inside them the elements whose names only hint at
noise (related-stories, notice-board). Repeated substrings of a host's streams, found by a suffix array, decide on what
markup leaves open there: blocks that they cover for the most part are boilerplate, and the unique runs are the text.

The suffix array is built by prefix doubling, over all pages of a host, however many. A suffix whose first RUN tokens lie
on one page only begins no repeat, so these prefixes are counted first (as 64-bit hashes, with the least and the largest
page that has them). The others get the names of their first 8, 16, 32, ... tokens, each made of two names of half the
length, as far as repeats go on. Suffixes are sorted by these names in ranges; the names that neighbours have in common
are their common prefix, and the longest one that distinct pages share is the repeat that begins there. It is known to
the power of two below its length: the suffixes of its later tokens cover the rest of it, so no token is lost.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import written
from lociforge.llm.words import CHUNK_BYTES, Words, chunks, grams, mix

#: Tokens of a repeated substring, share of a block that must be covered.
RUN, COVERED = 8, 0.5

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object canvas xmp noembed noframes".split())
NOISE_TAGS = frozenset("nav header footer aside form button select menu dialog head label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus"
    " footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply"
    " share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
REPLY_NAMES = frozenset("comment comments reply replies".split())
#: What may stand beside a noise name in a compound such as site-footer; other compounds (social-studies) are not noise.
QUALIFIERS = frozenset(
    "area bar block bottom box button buttons container form global icon icons inner item items left link links list main media outer page policy primary right secondary section site slot sticky top unit user users wrap"
    " wrapper".split()
)
#: What may stand beside one but a header: an article's header holds its title, its footer no text.
OWNERS = frozenset("article entry post posts".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
#: A start of one of these ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*>|<(?=/?[a-zA-Z]).*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SCOPES = frozenset("ul ol dl table select".split())

NOISE, OPEN, MAIN, ARTICLE, DOUBT = range(5)  # DOUBT: inside an article, in an element whose name hints at noise


def _role(tag: str, attributes: str, inside: int) -> int:
    """What an element makes of its content, that around it being `inside`."""
    if inside == NOISE or tag in NOISE_TAGS:
        return NOISE
    names: list[list[str]] = []
    hidden, strong = False, tag in ("article", "main")
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
            if name in ("class", "id"):
                names += [[p.lower() for p in _PART.findall(x)] for x in value.split()]
                continue
            value = value.lower()
            if name == "role":
                if value in NOISE_ROLES:
                    return NOISE
                strong |= value == "main"
            elif name == "itemprop":
                strong |= value == "articlebody"
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    if tag in ("html", "body"):
        return inside
    noise = NOISE_NAMES if not strong else REPLY_NAMES
    named = lambda parts: any(p in noise for p in parts) and all(p in noise or p in QUALIFIERS or p in OWNERS and "header" not in parts for p in parts)
    if hidden or any(named(parts) for parts in names):
        return NOISE
    if inside >= ARTICLE and (inside == DOUBT or not strong and any("header" not in parts and any(p in noise for p in parts) for parts in names)):
        return DOUBT
    if tag == "article" or strong and tag != "main":
        return ARTICLE
    return max(inside, MAIN) if strong or any(p in MAIN_NAMES for parts in names for p in parts) else inside


class _Open:
    """The open elements. Each knows where the topmost block element and the topmost list or table at or below it are, and
    each tag where it is open, so no start or end of an element looks through the others, however deep they are nested.
    """

    def __init__(self):
        self.tags: list[tuple[str, int, int, int]] = []
        self.places: dict[str, list[int]] = {}

    @property
    def role(self) -> int:
        return self.tags[-1][1] if self.tags else OPEN

    @property
    def block(self) -> int:
        return self.tags[-1][2] if self.tags else -1

    @property
    def scope(self) -> int:
        return self.tags[-1][3] if self.tags else -1

    def last(self, tag: str) -> int:
        """Where the tag is open last; -1 if nowhere."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, role: int) -> None:
        n = len(self.tags)
        self.places.setdefault(tag, []).append(n)
        self.tags.append((tag, role, n if tag in BLOCK_TAGS else self.block, n if tag in SCOPES else self.scope))

    def cut(self, n: int) -> None:
        """Ends the elements from the n-th up."""
        while len(self.tags) > n:
            self.places[self.tags.pop()[0]].pop()


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's non-empty blocks in order: what they lie in, and their text. Time grows with the page's length."""
    return [(min(role, ARTICLE), text) for role, text in _blocks(page)]


def _blocks(page: str | None) -> list[tuple[int, str]]:
    """The same, blocks in doubt told apart."""
    out: list[tuple[int, str]] = []
    piece: list[tuple[int, str]] = []
    stack = _Open()

    def flush() -> None:
        """Ends a block. Its pieces are told apart by what they lie in: noise inside a line leaves the line, and does not part it."""
        if not piece:
            return
        runs: list[list[tuple[int, str]]] = []
        aside = []
        for role, text in piece:
            if role == NOISE:
                aside.append((role, text))
            elif runs and min(runs[-1][0][0], ARTICLE) == min(role, ARTICLE):
                runs[-1].append((role, text))
            else:
                runs.append([(role, text)])
        for run in [*runs, aside]:
            if text := " ".join("".join(t for _, t in run).split()):
                out.append((min((r for r, t in run if t.strip()), default=NOISE), text))  # a line is in doubt as a whole
        piece.clear()

    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if not tag:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                piece.append((stack.role, html.unescape(m[0])))
            elif m[0].startswith("<![CDATA["):
                piece.append((stack.role, m[0][9:-3]))
            continue
        tag = tag.lower()
        if tag in RAW_TAGS and not m[1]:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "br":
            piece.append((stack.role, " "))
            continue
        if m[1]:
            k = stack.last(tag)
            if k >= 0:
                if tag in BLOCK_TAGS or stack.block >= k:
                    flush()
                stack.cut(k)
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            if stack.block >= 0 and stack.tags[stack.block][0] == "p":
                stack.cut(stack.block)
            for other in CLOSES.get(tag, ()):
                k = stack.last(other)
                if k >= 0 and stack.scope < k:
                    stack.cut(k)
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            stack.push(tag, _role(tag, m[3], stack.role))
    flush()
    return out


HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
TEXT = "page_id bigint, url string, text string"
STREAM = "page_id bigint, url string, page bigint, copy bigint, host string, roles array<tinyint>, settled array<string>, outside array<string>, chunk bigint, at int"
RUNS = "run bigint, low bigint, high bigint"
ASKED = "chunk bigint, run bigint"
SUFFIXES = "chunk bigint, names array<bigint>, low bigint, high bigint, places array<int>"
REPEATS = "names array<bigint>, size int"
GONE = "chunk bigint, gone array<array<int>>"
#: What a page counts for in a chunk besides its stream's characters, so that pages without any don't make it endless.
PAGE = 100


def _number(host: str, texts: Iterable[str]) -> int:
    return _digest("\n".join((host, *texts))) - (1 << 63)


def _page(host: str, found: list[tuple[int, str]]) -> int:
    """A number of the page: those of the host with the same blocks in the same parts have the same."""
    return _number(host, (f"{role}{text}" for role, text in found))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page: settled, an article's text; outside, what markup doesn't settle as that.

    copy: a number of the page's whole text; chunk: one of the pages read together, whose streams have some CHUNK_BYTES; at: the page's place in it.
    """
    chunk, n, held = 0, 0, CHUNK_BYTES
    for batch in chunks(batches, "html"):
        if held >= CHUNK_BYTES:
            chunk, n, held = uuid.uuid4().int >> 65, 0, 0
        found = [_blocks(text) for text in batch.column("html").to_pylist()]
        hosts = batch.column("host").to_pylist()
        outside = [[t for r, t in x if r != ARTICLE] for x in found]
        strings = pa.list_(pa.string())
        columns = {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "page": pa.array([_page(*x) for x in zip(hosts, found, strict=True)], pa.int64()),
            "copy": pa.array([_number(host, (t for _, t in x)) for host, x in zip(hosts, found, strict=True)], pa.int64()),
            "host": batch.column("host"),
            "roles": pa.array([[r for r, _ in x] for x in found], pa.list_(pa.int8())),
            "settled": pa.array([[t for r, t in x if r == ARTICLE] for x in found], strings),
            "outside": pa.array(outside, strings),
            "chunk": pa.array(np.full(len(found), chunk)),
            "at": pa.array(np.arange(n, n + len(found), dtype=np.int32)),
        }
        n, held = n + len(found), held + sum(PAGE + sum(map(len, x)) for x in outside)
        yield pa.record_batch(list(columns.values()), list(columns))


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of `run` tokens (a power of two) that occurs on distinct pages.

    tokens are the pages' streams one after the other, each closed by a token that occurs nowhere else.
    """
    rank, size = np.unique(tokens, return_inverse=True)[1], 1
    while size < run and len(rank) > size:
        key = rank[:-size].astype(np.int64) * (int(rank.max()) + 1) + rank[size:]
        rank, size = np.unique(key, return_inverse=True)[1], size * 2
    covered = np.zeros(len(tokens) + 1, np.int64)
    if size == run and len(rank):
        suffixes = np.argsort(rank, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(rank[suffixes]) > 0))
        on = page[suffixes]
        distinct = np.minimum.reduceat(on, first) < np.maximum.reduceat(on, first)
        starts = suffixes[distinct.repeat(np.diff(np.append(first, len(suffixes))))]
        np.add.at(covered, starts, 1)
        np.subtract.at(covered, starts + run, 1)
    return np.cumsum(covered[:-1]) > 0


def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _runs(outside: pa.Array, host: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each page's tokens and each block's begin; of all runs the first tokens, hashes with the host, and pages."""
    if isinstance(outside, pa.ChunkedArray):
        outside, host = outside.combine_chunks(), host.combine_chunks()
    words = Words(outside.flatten())
    of = words.of[np.append(0, np.cumsum(outside.value_lengths().to_numpy(zero_copy_only=False)))]
    h, page = grams(words.hashes(), RUN), np.repeat(np.arange(len(of) - 1), np.diff(of))
    at = np.flatnonzero(np.arange(len(h)) + RUN <= of[1:][page[: len(h)]])
    page = page[at]
    hosts = np.array([_digest(x) for x in host.to_pylist()], np.uint64)
    return of, words.of, at, mix(h[at], hosts[page]).view(np.int64), page


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct runs, with the least and the largest page (copies being one) that has them."""
    for batch in batches:
        *_, run, row = _runs(batch.column("outside"), batch.column("host"))
        if not len(run):
            continue
        page = batch.column("copy").to_numpy()[row]
        order = np.lexsort((page, run))
        run, page = run[order], page[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        yield pa.record_batch([pa.array(run[first]), pa.array(page[first]), pa.array(page[np.append(first[1:], len(run)) - 1])], ["run", "low", "high"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each chunk's pages."""
    for batch in batches:
        *_, run, row = _runs(batch.column("outside"), batch.column("host"))
        chunk = batch.column("chunk").to_numpy()[row]
        for one in np.unique(chunk):
            runs = np.unique(run[chunk == one])
            yield pa.record_batch([pa.array(np.full(len(runs), one)), pa.array(runs)], ["chunk", "run"])


def doubled(run: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first RUN, 2 * RUN, 4 * RUN, ... tokens of suffixes, a row for each suffix, and how many it has.

    run are the hashes of the first RUN tokens; the suffixes that begin at the left - 1 tokens after each follow it.
    """
    names, size, at = [run], RUN, np.arange(len(run))
    count = np.ones(len(run), np.int64)
    while len(at := at[left[at] + RUN - 1 >= 2 * size]):
        longer = np.zeros(len(run), np.int64)
        longer[at] = mix(names[-1][at].view(np.uint64), names[-1][at + size].view(np.uint64)).view(np.int64)
        names.append(longer)
        count[at] += 1
        size *= 2
    return np.stack(names, 1), count


def _once(pages: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The streams of a chunk's distinct pages in one order, and which of them each page has."""
    _, first, which = np.unique(pages.column("page").to_numpy(), return_index=True, return_inverse=True)
    return pages.take(pa.array(first)), which


def _suffixes(pages: pa.Table, answers: pa.Table) -> pa.Table:
    """Distinct suffixes of a chunk's streams that begin with a repeated run: their names and where they are."""
    once, _ = _once(pages)
    *_, at, run, row = _runs(once.column("outside"), once.column("host"))
    kept = np.isin(run, answers.column("run").to_numpy())
    at, run, row = at[kept], run[kept], row[kept]
    if not len(at):
        return pa.table({"chunk": pa.array([], pa.int64()), "names": pa.array([], pa.list_(pa.int64())), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64()), "places": pa.array([], pa.list_(pa.int32()))})
    ends = np.flatnonzero(np.append((at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]), True))
    names, count = doubled(run, ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + 1)
    copy, longest = once.column("copy").to_numpy()[row], names[np.arange(len(at)), count - 1]
    order = np.lexsort((at, longest, count))
    copy, at, longest, count, names = copy[order], at[order], longest[order], count[order], names[order]
    first = np.flatnonzero(np.append(True, (longest[1:] != longest[:-1]) | (count[1:] != count[:-1])))
    held = np.arange(names.shape[1]) < count[first, None]
    columns = [
        pa.array(np.full(len(first), pages.column("chunk")[0].as_py())),
        pa.ListArray.from_arrays(np.append(0, np.cumsum(count[first])).astype(np.int32), pa.array(names[first][held])),
        pa.array(np.minimum.reduceat(copy, first)),
        pa.array(np.maximum.reduceat(copy, first)),
        pa.ListArray.from_arrays(np.append(first, len(at)).astype(np.int32), pa.array(at.astype(np.int32))),
    ]
    return pa.table(columns, ["chunk", "names", "low", "high", "places"])


def longest_repeats(names: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Tokens of the longest prefix of each sorted suffix that distinct pages share, by common prefixes of neighbours."""
    size = np.zeros(len(names), np.int32)
    common, same = np.zeros(len(names), np.int64), np.ones(max(len(names) - 1, 0), bool)
    for k in range(names.shape[1]):
        same &= (names[1:, k] == names[:-1, k]) & (np.minimum(count[1:], count[:-1]) > k)
        common[1:] += same
    for k in range(names.shape[1]):
        first = np.flatnonzero(common <= k)
        shared = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
        size[np.repeat(shared, np.diff(np.append(first, len(names)))) & (count > k)] = RUN << k
    return size


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats that begin at the suffixes of a range of the sorted suffixes; suffixes of one run are in one range."""

    def told(part: pa.Table) -> pa.RecordBatch:
        lists = part.column("names").combine_chunks()
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names = np.zeros((len(count), count.max()), np.int64)
        names[np.arange(names.shape[1]) < count[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        size = longest_repeats(names, count, part.column("low").to_numpy(), part.column("high").to_numpy())
        return pa.record_batch([lists, pa.array(size)], ["names", "size"]).filter(pa.array(size > 0))

    rest = None
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, batch]) if rest is not None else batch
        run = rest.column("run").to_numpy()
        whole = int(np.flatnonzero(np.append(True, run[1:] != run[:-1]))[-1]) if len(run) else 0
        if whole:
            yield told(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield told(rest)


def _gone(pages: pa.Table, found: pa.Table) -> pa.Table:
    """For the pages of a chunk, in their order in it: which blocks of the stream are covered by repeats for the most part."""
    once, which = _once(pages)
    of, blocks_of, *_ = _runs(once.column("outside"), once.column("host"))
    places = found.column("places").combine_chunks()
    start, size = places.flatten().to_numpy(zero_copy_only=False), np.repeat(found.column("size").to_numpy(), places.value_lengths().to_numpy(zero_copy_only=False))
    covered = np.zeros(of[-1] + 1, np.int64)
    np.add.at(covered, start, 1)
    np.subtract.at(covered, start + size, 1)
    total = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
    gone = np.diff(total[blocks_of]) >= COVERED * np.diff(blocks_of)
    first = np.append(0, np.cumsum(once.column("outside").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)))
    lists = [np.flatnonzero(gone[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    order = np.argsort(pages.column("at").to_numpy())
    verdicts = pa.array([[lists[k] for k in which[order]]], pa.list_(pa.list_(pa.int32())))
    return pa.table([pa.array([pages.column("chunk")[0].as_py()]), verdicts], ["chunk", "gone"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page, of whose stream the blocks gone are boilerplate: these go where markup leaves them open."""
    for batch in batches:
        texts = []
        for roles, settled, outside, gone in zip(*(batch.column(c).to_pylist() for c in ("roles", "settled", "outside", "gone")), strict=True):
            most, gone = max(roles, default=NOISE), set(gone or ())
            wanted = {ARTICLE, DOUBT} if most >= ARTICLE else {most} - {NOISE}  # a main region narrows down where the text can be
            kept, doubtful, settled, outside = [], [], iter(settled), enumerate(outside)
            for role in roles:
                k, text = (None, next(settled)) if role == ARTICLE else next(outside)
                if role in wanted:
                    (doubtful if k in gone else kept).append(text)
            # an article of repeats alone is a copy of another
            texts.append("\n\n".join(kept or (doubtful if most >= ARTICLE else ())))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def html_text(df: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html).

    Returns page_id, url, text, one row for each input row: blocks in page order joined by a blank line, character
    references decoded, white space inside a block one space. Null or empty html, and pages without text, give ''.
    A url without a host (null, too) belongs to the host ''. Copies of a page (with the same text) count as one when repeats are looked for.
    Markup that ends in the middle is read as far as it goes, at any depth. Null page_ids stay null, and rows that repeat
    one each get their text. An empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    # texts are kept once, in buckets of chunks: they wait there for their verdicts and are not shuffled
    streams = written(pages.mapInArrow(_streams, STREAM), "zstd", "chunk")
    told = streams.select("copy", "host", "outside").mapInArrow(_told, RUNS)
    repeated_runs = told.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("run")
    answers = streams.select("host", "outside", "chunk").mapInArrow(_asked, ASKED).join(repeated_runs, "run", "left_semi").select("chunk", "run")
    by_chunk = streams.select("page", "copy", "host", "outside", "chunk", "at").groupBy("chunk")
    suffixes = written(by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_suffixes, SUFFIXES), "zstd")
    name = [F.element_at("names", -1).alias("name"), F.size("names").alias("levels")]  # a suffix's longest name tells the shorter ones
    distinct = suffixes.groupBy("names").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("run", F.col("names")[0])
    repeats = distinct.repartitionByRange("run").sortWithinPartitions("names").mapInArrow(_repeats, REPEATS)
    found = suffixes.select("chunk", "places", *name).join(repeats.select("size", *name), ["name", "levels"]).select("chunk", "places", "size")
    gone = written(by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(_gone, GONE), "zstd")
    # verdicts of each chunk: they grow with the pages, so they are not sent to every worker
    judged = streams.join(gone.hint("shuffle_hash"), "chunk", "left").select("page_id", "url", "roles", "settled", "outside", F.get("gone", "at").alias("gone"))
    return judged.mapInArrow(_texts, TEXT)
