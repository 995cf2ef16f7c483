"""Prefix trie of conversations: which ones begin alike, and what sharing their beginnings saves.

A turn is told by 128 bits of a digest of its role and text, a conversation by the digests of its turns one after the
other: a binary key, whose order puts a sequence right before those that it begins. All keys are range-sorted over the
cluster (equal keys by their ids, so that a large group of copies is spread, too). Along that order a trie node of depth d
is an interval: neighbours that have at least d turns in common.

1. Sweep: each partition computes the common turns of neighbours (LCP) and keeps a stack of open nodes. A node whose
   interval ends inside is finished there. Nodes that hold the partition's first or last conversation may go on beyond it;
   they leave as one packed summary for each partition, with what was finished below them already added up.
2. Stitch: the summaries, one row for each partition, are read in order; nodes still open at the end of one partition go
   on as deep as they share turns with the first conversation of the next, and are finished where that ends. One task
   does it in a stream: it holds one stack, however many partitions there are.
3. Nodes whose parent was open learn the parent's smallest member by a join on the parent's path; they travel as one row
   for each partition and parent.

What a task holds is a partition of keys (16 bytes a turn). A single conversation is held whole: some 24 bytes a turn.
The SHA-256 of a node's members is one stream by its definition; the ids of copies that fill several partitions are read
by the stitching task a partition at a time, never together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import written
from lociforge.llm.words import bytes_of

#: Bytes of a turn's digest, turns for each partition of the sorted keys.
DIGEST, PARTITION_TURNS = 16, 200_000
WORD = r"[^\x20\x09-\x0D]+"

_NODE = pa.struct([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
#: A node that may go on: what is known of it in one partition; ends: ids of members that end here, comma-joined.
_OPEN = pa.struct([("least", pa.int64()), ("convs", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.binary())])
#: Finished nodes under an open parent (parent: its path) or none; or a partition's summary: its first and last keys, the
#: depth that all its conversations share, open nodes from the root to the first key, and those beyond it to the last key.
_SWEPT = pa.schema([("parent", pa.binary()), ("nodes", pa.list_(_NODE)), ("first", pa.binary()), ("first_id", pa.int64()), ("last", pa.binary()), ("shared", pa.int64()), ("left", pa.list_(_OPEN)), ("right", pa.list_(_OPEN))])
_STITCHED = pa.schema([("path", pa.binary()), ("parent", pa.binary()), ("node", _NODE)])

_NODE_SQL = "struct<conv_id:bigint,depth:bigint,parent_conv_id:bigint,n_convs:bigint,n_children:bigint,n_leaves:bigint,saved_tokens:bigint,ends_sha256:string>"
_OPEN_SQL = "struct<least:bigint,convs:bigint,children:bigint,leaves:bigint,saved:bigint,words:bigint,ends:binary>"
_SWEPT_SQL = f"parent binary, nodes array<{_NODE_SQL}>, first binary, first_id bigint, last binary, shared bigint, left array<{_OPEN_SQL}>, right array<{_OPEN_SQL}>"
_STITCHED_SQL = f"path binary, parent binary, node {_NODE_SQL}"


def turn_arrays(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as (digest, words).

    Turns are ordered by turn_col, null first, and those that tie by their digests. Null role or text is empty. Rows that
    repeat are turns of their own. Rows with a null conv_id are left out. Other columns may have any names.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    said = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words")).alias("said"))
    turns = F.transform(F.sort_array(F.collect_list("said")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return said.where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common from the start."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(k[:n], f"V{DIGEST}") for k in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n // DIGEST


def lcps(data: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Common turns of each key and the one before; data: digests of all keys as two numbers each, of: where each key's begin."""
    size = np.diff(of)
    out = np.minimum(size[1:], size[:-1])
    ends = np.append(0, np.cumsum(out))
    step = np.arange(ends[-1]) - np.repeat(ends[:-1], out)
    differ = (data[np.repeat(of[:-2], out) + step] != data[np.repeat(of[1:-1], out) + step]).any(1)
    at = np.flatnonzero(differ)
    row = np.searchsorted(ends, at, "right") - 1
    np.minimum.at(out, row, step[at])
    return out


def _paths(key: bytes, upto: int) -> list[bytes]:
    """Digests of the key's beginnings of 0 to upto turns."""
    h, out = hashlib.blake2b(digest_size=DIGEST), []
    for d in range(upto + 1):
        out.append(h.copy().digest())
        h.update(key[DIGEST * d : DIGEST * (d + 1)])
    return out


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Partition:
    """Conversations of one partition in order: ids, turns, words of all turns, and the common turns of neighbours."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        ids, sizes, shared, words, self.first, self.last = [], [], [], [], b"", b""
        for batch in batches:
            if not batch.num_rows:
                continue
            data, of = bytes_of(batch.column("key"))
            if not ids:
                self.first = data[: of[1]].tobytes()
            head = np.frombuffer(self.last, np.uint8) if ids else data[:0]
            of = np.append(0, of + len(head)) // DIGEST
            between = lcps(np.frombuffer(np.concatenate([head, data]).tobytes(), "<u8").reshape(-1, 2), of)
            shared.append(between if ids else np.append(-1, between[1:]))
            ids.append(batch.column("id").to_numpy())
            sizes.append(np.diff(of)[1:])
            words.append(batch.column("words").flatten().to_numpy())
            self.last = data[(of[-2] - of[1]) * DIGEST :].tobytes()
        self.ids, self.sizes, self.shared, self.words = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (ids, sizes, shared, words))

    def nodes(self) -> dict[str, list]:
        """All nodes, each after its parent, by a sweep with a stack; end: the row that ended it."""
        names = ("depth", "parent", "start", "end", "least", "words", "children", "leaves", "saved", "ends", "ended")
        out = {k: [] for k in names}
        depth, parent, start, end, least, words, children, leaves, saved, ends, ended = out.values()
        n, stack, at = len(self.ids), [], 0
        text = self.words.tolist()

        def close(row: int) -> None:
            k = stack.pop()
            end[k] = row
            is_open = start[k] == 0 or row == n
            if not is_open:
                leaves[k] = leaves[k] or 1
                saved[k] += (row - start[k] - 1) * words[k]
            if stack:
                p = stack[-1]
                least[p] = min(least[p], least[k])
                if not is_open:
                    children[p] += 1
                    leaves[p] += leaves[k]
                    saved[p] += saved[k]

        for row, (i, size, both) in enumerate(zip(self.ids.tolist(), self.sizes.tolist(), self.shared.tolist(), strict=True)):
            while len(stack) > both + 1:
                close(row)
            for d in range(both + 1, size + 1):
                for column, v in zip(out.values(), (d, stack[-1] if stack else -1, row, 0, i, text[at + d - 1] if d else 0, 0, 0, 0, row, row), strict=True):
                    column.append(v)
                stack.append(len(depth) - 1)
            k = stack[-1]
            least[k] = min(least[k], i)
            if ended[k] == ends[k]:
                ends[k] = row
            ended[k] = row + 1
            at += size
        while stack:
            close(n)
        return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = _Partition(batches)
    n = len(part.ids)
    if not n:
        return
    t = {k: np.array(v, np.int64) for k, v in part.nodes().items()}
    done = (t["start"] > 0) & (t["end"] < n)
    inner = done & done[t["parent"]] & (t["parent"] >= 0)
    sha = lambda k: hashlib.sha256(_joined(part.ids[t["ends"][k] : t["ended"][k]])).hexdigest() if t["ended"][k] > t["ends"][k] else NO_ENDS

    def finished(which: np.ndarray, parents: np.ndarray | None) -> pa.Array:
        up = pa.array(parents, pa.int64()) if parents is not None else pa.nulls(len(which), pa.int64())
        columns = [pa.array(t["least"][which]), pa.array(t["depth"][which]), up, pa.array((t["end"] - t["start"])[which]), *(pa.array(t[c][which]) for c in ("children", "leaves", "saved")), pa.array([sha(k) for k in which], pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(_NODE))

    def rows(parents: list[bytes | None], nodes: pa.Array, cut: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), nodes)
        return pa.record_batch([pa.array(parents, pa.binary()), lists, *(pa.nulls(len(parents), f.type) for f in list(_SWEPT)[2:])], schema=_SWEPT)

    known = np.flatnonzero(inner)
    yield rows([None], finished(known, t["least"][t["parent"][known]]), np.array([0, len(known)]))
    # finished nodes below an open one, whose smallest member is not known here
    below = np.flatnonzero(done & ~inner)
    below = below[np.argsort(t["parent"][below], kind="stable")]
    last_left = np.flatnonzero(t["start"] == 0)
    paths = {k: p for k, p in zip(last_left, _paths(part.first, len(last_left) - 1), strict=True)}
    spine = np.flatnonzero((t["start"] > 0) & (t["end"] == n))
    paths |= {k: p for k, p in zip(spine, _paths(part.last, int(part.sizes[-1]))[len(part.last) // DIGEST + 1 - len(spine) :], strict=True)}
    if len(below):
        parent = t["parent"][below]
        head = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        yield rows([paths[k] for k in parent[head]], finished(below, None), np.append(head, len(below)))
    entry = lambda k: {"least": t["least"][k], "convs": t["end"][k] - t["start"][k], "children": t["children"][k], "leaves": t["leaves"][k], "saved": t["saved"][k], "words": t["words"][k], "ends": _joined(part.ids[t["ends"][k] : t["ended"][k]])}
    shared = int((t["end"][last_left] == n).sum()) - 1
    yield pa.RecordBatch.from_pylist([{"first": part.first, "first_id": int(part.ids[0]), "last": part.last, "shared": shared, "left": [entry(k) for k in last_left], "right": [entry(k) for k in spine]}], schema=_SWEPT)


class _Open:
    """A node that is still open while partitions are stitched."""

    def __init__(self, path: bytes):
        self.path, self.least, self.convs, self.children, self.leaves, self.saved, self.words, self.ends, self.any = path, None, 0, 0, 0, 0, 0, hashlib.sha256(), False

    def add(self, e: dict) -> None:
        self.least = e["least"] if self.least is None else min(self.least, e["least"])
        self.convs += e["convs"]
        self.children += e["children"]
        self.leaves += e["leaves"]
        self.saved += e["saved"]
        self.words = e["words"]
        if e["ends"]:
            self.ends.update(b"," * self.any + e["ends"])
            self.any = True


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[_Open] = []
    out: list[dict] = []

    def close() -> None:
        x, depth = stack.pop(), len(stack)
        x.leaves = x.leaves or 1
        x.saved += (x.convs - 1) * x.words
        if stack:
            up = stack[-1]
            up.children += 1
            up.leaves += x.leaves
            up.saved += x.saved
        node = {"conv_id": x.least, "depth": depth, "parent_conv_id": None, "n_convs": x.convs, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "ends_sha256": x.ends.hexdigest()}
        out.append({"path": x.path, "parent": stack[-1].path if stack else None, "node": node})

    def rest(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) > least:
            yield pa.RecordBatch.from_pylist(out, schema=_STITCHED)
            out.clear()

    before = None
    for batch in batches:
        for r in range(batch.num_rows):
            s = batch.slice(r, 1).to_pylist()[0]
            keep = common(before, s["first"]) + 1 if before is not None else 0
            while len(stack) > keep:
                close()
            paths = _paths(s["first"], len(s["left"]) - 1)
            for d, e in enumerate(s["left"]):
                if d == len(stack):
                    stack.append(_Open(paths[d]))
                stack[d].add(e)
            while len(stack) > s["shared"] + 1:
                close()
            paths = _paths(s["last"], len(s["last"]) // DIGEST)
            for e in s["right"]:
                stack.append(_Open(paths[len(stack)]))
                stack[-1].add(e)
            before = s["last"]
            yield from rest(10_000)
    while stack:
        close()
    yield from rest(0)


def prefix_trie(turns: DataFrame, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """The trie of the conversations of turn_arrays: a row for each distinct sequence of first turns, the empty one (root) included.

    turns: conv_id and turns, one row for each conversation; those without turns end at the root. Returns conv_id (the
    smallest member: members begin with the node's turns), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (over the subtree, the words of
    each node's last text times its members but one), ends_sha256 (of the ids, ascending and comma-joined, of members that
    end at the node). Rows with a null conv_id are left out. An empty table gives an empty result. Turns may be of any
    length: only their digests travel.
    """
    keyed = written(turns.where("conv_id is not null").select(F.col("conv_id").alias("id"), F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.words").alias("words")))
    n_turns = keyed.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0)).alias("n")).first().n
    n_parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // partition_turns))
    swept = written(keyed.repartitionByRange(n_parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_sweep, _SWEPT_SQL))
    summaries = swept.where("first is not null").select("first", "first_id", "last", "shared", "left", "right")
    stitched = written(summaries.coalesce(1).sortWithinPartitions("first", "first_id").mapInArrow(_stitch, _STITCHED_SQL))
    known = swept.where("first is null and parent is null").select(F.inline("nodes"))
    under = swept.where("parent is not null").select("parent", "nodes").unionByName(stitched.select("parent", F.array("node").alias("nodes")))
    parents = stitched.select(F.col("path").alias("parent"), F.col("node.conv_id").alias("up"))
    found = under.join(parents, "parent", "left").select("up", F.inline("nodes"))
    return known.unionByName(found.withColumn("parent_conv_id", F.col("up")).drop("up"))
