"""Substring deduplication by level-wise doubling.

A passage of `window` words that also starts in an earlier document can only be there if each shorter run
inside it is repeated as well. So the search goes up by levels, each about twice as long as the one before
(7 and 13 words for the default window):

1. At the short level, each window of full length names its smallest short run (the minimum of their hashes,
   so equal windows name equal runs). Named runs go to the segment of their hash; those found in one place
   alone die there.
2. At the next level only windows whose named run survived are hashed again, and so on, until the level is
   the full window or nothing survives. At the full length each hash keeps its smallest document; the same
   words in any later document are removed.

A map task first compares within its own chunk of documents: what is decided there (a run repeated inside
the chunk, a window whose earlier owner is in the chunk) needs no answer from elsewhere, and a chunk sends
a hash for one document only. A passage in a third of all documents so costs one entry a chunk, not one a
document. What travels is packed: one row per chunk and segment. The number of segments follows the input.

Windows of full length are compared by 96 bits of two hashes of their words: among 10^13 windows two unlike ones meet
with a probability below 10^-3. All word positions are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.store import segments, text_bytes
from lociforge.llm.words import Words, blobs, chunks, grams, mix, unblob

#: What a chunk of documents (named by its first) sends to a segment: documents, entries of each, word positions, hashes.
BLOCK = "segment int, chunk bigint, answered boolean, docs binary, sizes binary, at binary, keys binary"
ANSWER = "chunk bigint, docs binary, sizes binary, at binary"
SPANS = "doc bigint, at binary"
CUT = T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_text", T.StringType())
#: What tells windows of full length apart: a hash, and a part of another.
PRINT = np.dtype([("a", "<u8"), ("b", "<u4")])
#: Text bytes for each segment.
SEGMENT_BYTES = 4 << 20


def levels(window: int, shortest: int = 6) -> list[int]:
    """Window lengths from the shortest level up; each is at most twice the one before."""
    out = [window]
    while out[0] > 1 and (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _named(h: np.ndarray, n: int, window: int, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of n words at each word, and the smallest of those inside the window at each word."""
    runs = np.zeros(len(h), np.uint64)
    g = grams(h, n)
    runs[: len(g)] = g
    least, size, want = runs, 1, window - n + 1
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least, np.append(least[step:], least[-1:].repeat(step))) if len(least) > step else least
        size += step
    return runs, least


def _entries(batch: pa.RecordBatch, words: Words, h: np.ndarray, n: int, window: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and hashes of the runs of n words that the windows name; alive: windows to look at."""
    here = np.arange(len(h)) + window <= words.row_end()
    if alive is not None:
        here &= alive
    if n == window:
        at = np.flatnonzero(here)
        g = grams(h, window)
        return at, g[at]
    runs, least = _named(h, n, window, here)
    named = np.zeros(len(h), bool)
    for d in range(min(window - n + 1, len(h))):
        k = len(h) - d
        named[d:] |= here[:k] & (least[:k] == runs[d:])
    at = np.flatnonzero(named)
    return at, runs[at]


def _windows(words: Words, h: np.ndarray, n: int, window: int, marked: np.ndarray) -> np.ndarray:
    """Windows whose named run of n words is marked."""
    runs, least = _named(h, n, window, marked)
    out = np.zeros(len(h), bool)
    for d in range(min(window - n + 1, len(h))):
        k = len(h) - d
        out[:k] |= marked[d:] & (least[:k] == runs[d:])
    return out


def _marks(words: Words, at: pa.Array) -> np.ndarray:
    """A flag for each word: its position in its row is listed in `at` (null: none)."""
    values, rows = unblob(at, np.uint32)
    out = np.zeros(len(words), bool)
    out[words.of[:-1].repeat(np.diff(rows)) + values] = True
    return out


def _spread(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, segment: np.ndarray, chunk: int, answered: bool) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK, one for each segment; doc, pos and key belong together."""
    if not len(doc):
        return
    order = np.argsort(segment, kind="stable")
    doc, pos, key, segment = doc[order], pos[order], key[order], segment[order]
    cut = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    run = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])))
    by_run, by_key = np.append(np.searchsorted(run, cut), len(run)), np.append(cut, len(doc))
    yield pa.record_batch(
        [
            pa.array(segment[cut].astype(np.int32)),
            pa.array(np.full(len(cut), chunk, np.int64)),
            pa.array(np.full(len(cut), answered)),
            blobs(doc[run].astype(np.int64), by_run).cast(pa.binary()),
            blobs(np.diff(np.append(run, len(doc))).astype(np.uint32), by_run).cast(pa.binary()),
            blobs(pos.astype(np.uint32), by_key).cast(pa.binary()),
            blobs(key[:0] if answered else key, by_key * 0 if answered else by_key).cast(pa.binary()),
        ],
        ["segment", "chunk", "answered", "docs", "sizes", "at", "keys"],
    )


def _second(h: np.ndarray, n: int) -> np.ndarray:
    """Half of a second hash of the run of n words at each word that has one."""
    return (grams(mix(h, np.uint64(0xA0761D6478BD642F)), n) >> np.uint64(32)).astype(np.uint32)


def _sender(n: int, window: int, n_segments: int):
    """The map side of a level: reads doc, text and, but for the first level, the marks of the level before."""
    before = {b: a for a, b in zip(levels(window), levels(window)[1:], strict=False)}.get(n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            if before:
                batch = batch.filter(batch.column("at").is_valid())
            words = Words(batch.column("text"))
            if not len(words):
                continue
            h = words.hashes()
            alive = _windows(words, h, before, window, _marks(words, batch.column("at"))) if before else None
            at, key = _entries(batch, words, h, n, window, alive)
            if not len(at):
                continue
            row = words.row_of()[at]
            doc, pos = batch.column("doc").to_numpy()[row], at - words.of[row]
            other = _second(h, n)[at] if n == window else np.zeros(len(at), np.uint32)
            order = np.lexsort((pos, doc, other, key))
            first = np.append(True, (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]))
            owner = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = doc[order] != owner
            if n == window:  # an earlier document of this chunk has the same words
                done, ask = order[later], order[~later]
            else:  # repeated inside the chunk: all its places survive, one goes on as evidence
                group = np.cumsum(first) - 1
                many = np.bincount(group, later) > 0
                done, ask = order[many[group]], order[first | ~many[group]]
            done.sort()
            ask.sort()
            segment = (key % np.uint64(n_segments)).astype(np.int64)
            # short runs are only candidates, for which half of the hash is enough
            sent = (key >> np.uint64(32)).astype(np.uint32)
            if n == window:
                sent = np.empty(len(key), PRINT)
                sent["a"], sent["b"] = key, other
            yield from _spread(doc[done], pos[done], sent[done], segment[done[:1]].repeat(len(done)), int(doc[0]), True)
            yield from _spread(doc[ask], pos[ask], sent[ask], segment[ask], int(doc[0]), False)

    return send


def _receiver(last: bool):
    """The reduce side of a level: entries of one segment in, surviving (or, at the last level, removed) places out."""

    def receive(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        answered = table.column("answered").to_numpy()
        docs, of_docs = unblob(table.column("docs"), np.int64)
        sizes, _ = unblob(table.column("sizes"), np.uint32)
        at, of_at = unblob(table.column("at"), np.uint32)
        keys, _ = unblob(table.column("keys"), PRINT if last else np.uint32)
        run_of = np.arange(len(docs)).repeat(sizes)
        block = np.arange(table.num_rows).repeat(np.diff(of_at))
        keep = answered[block]
        asked = np.flatnonzero(~keep)
        if len(asked):
            coded = pa.Array.from_buffers(pa.binary(PRINT.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]) if last else pa.array(keys)
            group = coded.dictionary_encode().indices.to_numpy()
            whose = docs[run_of[asked]]
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, whose)
            if last:
                keep[asked] = whose > least[group]
            else:
                most = np.full(len(least), np.iinfo(np.int64).min)
                np.maximum.at(most, group, whose)
                keep[asked] = least[group] < most[group]
        at, run_of = at[keep], run_of[keep]
        of_run = np.append(0, np.cumsum(np.bincount(run_of, minlength=len(docs))))
        rows = of_docs  # every document of a block is answered, if with no places
        out = [table.column("chunk"), table.column("docs"), blobs(np.diff(of_run).astype(np.uint32), rows).cast(pa.binary()), blobs(at, of_run[rows]).cast(pa.binary())]
        return pa.table(out, ["chunk", "docs", "sizes", "at"])

    return receive


def _gather(table: pa.Table) -> pa.Table:
    """Answers to one chunk of documents: a row for each document that has places."""
    table = table.combine_chunks()
    docs, _ = unblob(table.column("docs"), np.int64)
    sizes, _ = unblob(table.column("sizes"), np.uint32)
    at, _ = unblob(table.column("at"), np.uint32)
    whose = docs.repeat(sizes)
    order = np.argsort(whose, kind="stable")
    whose = whose[order]
    cut = np.flatnonzero(np.append(True, whose[1:] != whose[:-1])) if len(whose) else np.zeros(0, np.int64)
    return pa.table([pa.array(whose[cut]), blobs(at[order], np.append(cut, len(at))).cast(pa.binary())], ["doc", "at"])


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """From (doc, text): doc, at - the word positions at which a window of an earlier document starts again."""
    n_segments = segments(text_bytes(docs), SEGMENT_BYTES)
    found = None
    for n in levels(window):
        # a left join keeps the documents' side the same for every level, so that their texts are dealt out once
        source = docs.where("doc is not null").select("doc", "text") if found is None else docs.join(found.hint("shuffle_hash"), "doc", "left")
        blocks = source.mapInArrow(_sender(n, window, n_segments), BLOCK)
        answers = blocks.groupBy("segment").applyInArrow(_receiver(n == window), ANSWER)
        spans = answers.groupBy("chunk").applyInArrow(_gather, SPANS)
        found = spans.groupBy("doc").agg(F.aggregate(F.collect_list("at"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("at"))
    return found


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            gone = np.zeros(len(words) + 1, np.int32)
            marks = np.flatnonzero(_marks(words, batch.column("at")))
            np.add.at(gone, marks, 1)
            np.subtract.at(gone, marks + window, 1)
            gone = np.cumsum(gone[:-1]) > 0
            total = np.append(0, np.cumsum(gone))
            yield pa.record_batch([*batch.columns, pa.array(words.counts), pa.array(np.diff(total[words.of])), words.joined(~gone).cast(pa.string())], [*batch.schema.names, "n_words", "n_removed", "kept_text"])

    return cut


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word that a window of `window` words covers whose word sequence starts in a document with a smaller id.

    Returns id_col, n_words, n_removed, kept_text (the kept words joined by one space), one row for each input row,
    and the columns of df that `carry` names (one that is named like a column returned is an error). Words are runs without white space (0x20, 0x09-0x0D).
    Null text: no words, kept_text ''. Null id: kept whole, and no evidence against others. Rows that repeat an id
    count as one document: none is earlier than the other, and what is removed is removed from each of them.
    An empty table gives an empty result. Texts of any length are judged whole.
    """
    if clash := {id_col, "n_words", "n_removed", "kept_text"} & set(carry):
        raise ValueError(f"cannot carry {', '.join(sorted(clash))}: the result has such columns of its own")
    rest = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in carry])
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), rest.alias("rest"))
    spans = repeated_spans(docs, window)
    joined = docs.join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "text", "rest", "at")
    schema = T.StructType([*joined.schema, *CUT])
    return joined.mapInArrow(_cutter(window), schema).select(F.col("doc").alias(id_col), "n_words", "n_removed", "kept_text", *[F.col("rest")[c].alias(c) for c in carry])
