"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items.

Every window is a set of word shingles. A document contains a window only if it has all of the window's
shingles, so it is enough to look for the rarest (the prefix that containment makes necessary):

1. Shingles of all windows are counted over all documents; each window keeps its rarest.
2. Each shingle of a document is looked up among these. A match says where the window would begin; it is
   dropped if it would begin before the document or end after it (positional and length bounds).
3. What is left is verified, the window's whole word sequence must stand there, byte by byte.

The index of windows goes to the workers. Its size is checked: items are taken in blocks of at most
BLOCK_BYTES of text, and each further block is a further pass that adds to what the one before found.
Shingles are looked up by 64-bit hashes; these only choose what is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.store import text_bytes, written
from lociforge.llm.words import ALNUM, Words, blobs, chunks, grams, unblob

#: Text of benchmark items whose windows are indexed at a time.
BLOCK_BYTES = 2 << 20
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3
FOUND = T.StructType().add("n_words", T.LongType()).add("hits", T.BinaryType()).add("items", T.ArrayType(T.StringType()))


class Lookup:
    """Positions of hashes in a sorted array; a bit table turns most others away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = max(16, int(len(self.keys) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of h that are keys, and of which key."""
        at = np.flatnonzero(self.table[h & self.mask])
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[key] == h[at]
        return at[good], key[good]


class Windows:
    """All windows of some items: word counts, hashes, shingles, and which items have them."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
        h, n = words.hashes(), words.counts
        size = np.minimum(n, window)
        per_item = np.where(n > 0, n - size + 1, 0)
        item = np.arange(len(ids)).repeat(per_item)
        start = np.arange(per_item.sum()) - (np.cumsum(per_item) - per_item).repeat(per_item) + words.of[:-1].repeat(per_item)
        length = size.repeat(per_item)
        key = np.zeros(len(start), np.uint64)
        for k in np.unique(length):
            here = length == k
            key[here] = grams(h, int(k))[start[here]]
        self.ids = np.array(ids, object)
        pairs = np.unique(np.rec.fromarrays([length, key, item], names="length,key,item"))
        both = pairs[["length", "key"]]
        first = np.append(True, both[1:] != both[:-1]) if len(both) else np.zeros(0, bool)
        #: Distinct windows: how many words, hash, and items of[w]:of[w + 1].
        self.length, self.key = pairs["length"][first], pairs["key"][first]
        self.items, self.of = pairs["item"], np.append(np.flatnonzero(first), len(pairs))
        at = np.full(len(self.key), 0)
        self.words, self.at = words, at
        for k in np.unique(length):
            mine, here = self.length == k, np.flatnonzero(length == k)
            order = here[np.argsort(key[here], kind="stable")]
            at[mine] = start[order[np.searchsorted(key[order], self.key[mine])]]
        #: Shingle hashes by window: shingles of window w begin at shingle_of[w].
        self.size = np.minimum(self.length, SHINGLE)
        self.n_shingles = self.length - self.size + 1
        self.shingle_of = np.append(0, np.cumsum(self.n_shingles))
        self.offset = np.arange(self.shingle_of[-1]) - self.shingle_of[:-1].repeat(self.n_shingles)
        place, kind = at.repeat(self.n_shingles) + self.offset, self.size.repeat(self.n_shingles)
        self.shingle = np.zeros(len(place), np.uint64)
        for k in np.unique(kind):
            self.shingle[kind == k] = grams(h, int(k))[place[kind == k]]
        self.kinds = [int(k) for k in np.unique(self.size)]

    def stand(self, words: Words, starts: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each start are, byte by byte, those of the window (of n words) beside it."""
        size, own = words.ends - words.starts, self.words.ends - self.words.starts
        here, there = starts[:, None] + np.arange(n), self.at[entry][:, None] + np.arange(n)
        good = (size[here] == own[there]).all(1)
        few = np.flatnonzero(good)
        here, there = here[few].ravel(), there[few].ravel()
        many = size[here]
        ends = np.append(0, np.cumsum(many))
        step = np.arange(ends[-1]) - ends[:-1].repeat(many)
        differ = words.data[words.starts[here].repeat(many) + step] != self.words.data[self.words.starts[there].repeat(many) + step]
        total = np.append(0, np.cumsum(differ))
        good[few] = total[ends[n::n]] == total[ends[:-1:n]]
        return good

    def drop_shingles(self) -> None:
        """Once the prefixes are chosen the other shingles are not needed, and workers do without."""
        del self.shingle, self.shingle_of, self.offset, self.n_shingles


def _shingles(words: Words, h: np.ndarray, k: int) -> np.ndarray:
    """Shingles of k words by first word, as far as they end in the row they begin in; 0 elsewhere."""
    g = np.zeros(len(h), np.uint64)
    own = grams(h, k)
    g[: len(own)] = own
    g[np.arange(len(h)) + k > words.row_end()] = 0
    return g


def _counter(lookup, kinds: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup.value
        total = np.zeros(len(table.keys), np.int64)
        for batch in chunks(batches):
            words = Words(batch.column("text"), ALNUM, lower=True)
            h = words.hashes()
            for k in kinds:
                total += np.bincount(table.find(_shingles(words, h, k))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["key", "n"])

    return count


def _finder(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, prefix, lookup, of, order = index.value
        for batch in chunks(batches):
            words = Words(batch.column("text"), ALNUM, lower=True)
            h, ends = words.hashes(), words.row_end()
            begins = words.of[:-1].repeat(words.counts)
            starts, found = [], []
            for k in w.kinds:
                at, key = lookup.find(_shingles(words, h, k))
                many = of[key + 1] - of[key]
                entry = order[np.arange(many.sum()) - (np.cumsum(many) - many).repeat(many) + of[key].repeat(many)]
                s = at.repeat(many) - prefix[entry]
                ok = (w.size[entry] == k) & (s >= begins[at.repeat(many)]) & (s + w.length[entry] <= ends[at.repeat(many)])
                s, entry = s[ok], entry[ok]
                for n in np.unique(w.length[entry]):
                    mine = w.length[entry] == n
                    same = np.flatnonzero(grams(h, int(n))[s[mine]] == w.key[entry[mine]])
                    same = same[w.stand(words, s[mine][same], entry[mine][same], int(n))]
                    starts.append(s[mine][same])
                    found.append(entry[mine][same])
            starts, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, found))
            cover = np.zeros(len(h) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.subtract.at(cover, starts + w.length[found], 1)
            hit = np.cumsum(cover[:-1]) > 0
            row_of = words.row_of()
            if "hits" in batch.schema.names:
                values, rows = unblob(batch.column("hits"), np.uint32)
                hit[words.of[:-1].repeat(np.diff(rows)) + values] = True
            at = np.flatnonzero(hit)
            hits = blobs((at - words.of[row_of[at]]).astype(np.uint32), np.searchsorted(at, words.of))
            many = w.of[found + 1] - w.of[found]
            item = w.items[np.arange(many.sum()) - (np.cumsum(many) - many).repeat(many) + w.of[found].repeat(many)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            if "items" in batch.schema.names:
                items = [set(x or ()) for x in batch.column("items").to_pylist()]
            for r, i in np.unique(np.stack([row_of[starts].repeat(many), item], 1), axis=0) if len(item) else ():
                items[r].add(w.ids[i])
            yield pa.record_batch(
                [*(batch.column(c) for c in ("id", "text", "rest")), pa.array(words.counts), hits.cast(pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["id", "text", "rest", "n_words", "hits", "items"],
            )

    return find


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Finds the words of each text that windows of benchmark items cover.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is `window` consecutive
    words of an item; an item of fewer words is one window. Returns for each row: id_col, n_words, n_hit (words inside
    an occurrence of a window), hits (their positions, 4 bytes each), items (sorted, as strings), contaminated
    (n_hit > 0 and share * n_hit >= n_words), and the columns of df that `carry` names
    (one that is named like a column returned is an error).
    Null or empty text: no words, clean. Null ids stay null. Items without an id, a text or a word match nothing;
    rows that repeat an item id count as one item. Empty tables give an empty result, or clean documents.
    """
    if clash := {id_col, "n_words", "n_hit", "hits", "items", "contaminated"} & set(carry):
        raise ValueError(f"cannot carry {', '.join(sorted(clash))}: the result has such columns of its own")
    rest = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in carry])
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    schema = T.StructType([*docs.schema, *FOUND])
    spark = df.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    blocks = max(1, -(-text_bytes(items) // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        w = Windows([r.item for r in rows], [r.text for r in rows], window)
        lookup = Lookup(w.shingle)
        counts = np.zeros(len(lookup.keys), np.int64)
        if len(counts):
            counted = docs.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(lookup), w.kinds), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
            for r in counted.collect():
                counts[r.key] = r.n
        # the rarest shingle of each window; of equally rare ones the first
        n = counts[np.searchsorted(lookup.keys, w.shingle)] if len(counts) else np.zeros(0, np.int64)
        rank = np.lexsort((w.offset, n, np.arange(len(w.key)).repeat(w.n_shingles)))
        rarest = rank[w.shingle_of[:-1]]
        prefix, place = w.shingle[rarest], w.offset[rarest]
        w.drop_shingles()
        lookup = Lookup(prefix)
        entry_key = np.searchsorted(lookup.keys, prefix)
        order = np.argsort(entry_key, kind="stable")
        of = np.append(0, np.cumsum(np.bincount(entry_key, minlength=len(lookup.keys))))
        docs = (written(docs) if b else docs).mapInArrow(_finder(spark.sparkContext.broadcast((w, place, lookup, of, order))), schema)
    n_hit = F.octet_length("hits").cast("long") / 4
    return docs.select(F.col("id").alias(id_col), "n_words", n_hit.cast("long").alias("n_hit"), "hits", "items", ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), *[F.col("rest")[c].alias(c) for c in carry])
