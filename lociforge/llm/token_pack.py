"""Token ids packed into fixed-length rows, by best-fit decreasing.

Texts are encoded with a public byte-level BPE vocabulary (a file of ranks, whose path is a parameter). What one space
parts is encoded once for each distinct piece of a shard; the vocabulary's pre-tokenizer never looks across such a
place. An end mark follows each document. A document longer than a row is split into full rows and a rest, without loss.

Documents are dealt to shards by a hash of id and text, and each shard is packed on its own: pieces in decreasing length,
each into the row with the least room that still holds it. Rows are found by a segment tree over the amounts of room.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import segments, text_bytes
from lociforge.llm.words import Words, blobs, bytes_of

#: Its file of ranks; every worker must have it at this path (or at that which token_pack is given).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 8 << 20
PACKED = "shard int, row int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<bigint>, parts array<int>"


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and where each text's begin."""
    data, rows = bytes_of(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    pad = np.concatenate([np.full(3, 0x20, np.uint8), data, np.full(1, 0x20, np.uint8)])
    before3, before2, before, after = pad[:n], pad[1 : n + 1], pad[2 : n + 2], pad[4:]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
    wide = np.zeros(256, bool)  # lead bytes of white space beyond ASCII
    wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    cut = (data == 0x20) & ~blank[before] & ~blank[after] & ~wide[after] & ~((before >= 0x80) & (wide[before3] | (before2 == 0xC2)))
    head = rows[:-1][rows[:-1] < rows[1:]]
    cut[head] = True
    piece = Words.__new__(Words)
    piece.data, piece.starts = data, np.flatnonzero(cut)
    piece.ends = np.append(piece.starts[1:], n)
    coded = pa.array(piece.hashes()).dictionary_encode()
    index = coded.indices.to_numpy()
    where = np.zeros(len(coded.dictionary), np.int64)
    where[index[::-1]] = np.arange(len(index))[::-1]
    enc = encoding(path)
    raw = data.tobytes()
    each = [enc.encode_ordinary(raw[a:b].decode()) for a, b in zip(piece.starts[where].tolist(), piece.ends[where].tolist(), strict=True)]
    size = np.array([len(x) for x in each], np.int64)
    flat, of = np.fromiter((t for x in each for t in x), np.int32, int(size.sum())), np.append(0, np.cumsum(size))
    many = size[index]
    ends = np.append(0, np.cumsum(many))
    ids = flat[np.arange(ends[-1]) + (of[index] - ends[:-1]).repeat(many)]
    return ids, ends[np.searchsorted(piece.starts, rows)]


class Rooms:
    """A segment tree over amounts of room; finds the least amount of at least n that some open row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.size + room
        while k and not self.tree[k]:
            self.tree[k] = 1
            k >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """The room and number of the row that fits n best; it leaves the tree."""
        k = self.size + n
        while not self.tree[k]:
            while k & 1:  # a right child: the next amounts lie right of an ancestor
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:
                return None
        while k < self.size:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.tree[k] = 0
            while k > 1 and not self.tree[k ^ 1]:
                k >>= 1
                self.tree[k] = 0
        return room, row


def best_fit(lengths: np.ndarray, row_length: int) -> np.ndarray:
    """Row number of each piece, pieces taken in decreasing length (ties in the given order)."""
    rooms, out, n = Rooms(row_length), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room, row = rooms.take(need) or (row_length, n)
        n += row == n
        out[k] = row
        rooms.put(room - need, row)
    return out


def _packer(path: str, row_length: int, end_id: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        shard = table.column("shard")[0].as_py()
        ids, of = encode(table.column("text"), path)
        size = np.diff(of) + 1
        tokens = np.full(size.sum(), end_id, np.int32)
        starts = np.cumsum(size) - size
        tokens[np.arange(len(ids)) + np.arange(len(size)).repeat(size - 1)] = ids
        n_parts = -(-size // row_length)
        doc = np.arange(len(size)).repeat(n_parts)
        part = np.arange(n_parts.sum()) - (np.cumsum(n_parts) - n_parts).repeat(n_parts)
        start = starts[doc] + part * row_length
        length = np.minimum(size[doc] - part * row_length, row_length)
        row = best_fit(length, row_length)
        order = np.lexsort((np.arange(len(row)), -length, row))
        row, doc, part, start, length = row[order], doc[order], part[order], start[order], length[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        to = np.append(first, len(row))
        ends = np.append(0, np.cumsum(length))
        place = np.arange(ends[-1]) - ends[:-1].repeat(length)
        matrix = tokens[place + start.repeat(length)]
        cum = [np.append(0, np.cumsum(length[a:b])).astype(np.int32) for a, b in zip(to[:-1], to[1:], strict=True)]
        names = table.column("id").to_numpy(zero_copy_only=False) if not table.column("id").null_count else np.array(table.column("id").to_pylist(), object)
        split = lambda x: [v.tolist() for v in np.split(x, to[1:-1])]
        return pa.table(
            [
                pa.array(np.full(len(first), shard, np.int32)),
                pa.array(np.arange(len(first), dtype=np.int32)),
                blobs(matrix, ends[to]).cast(pa.binary()),
                pa.array(cum, pa.list_(pa.int32())),
                blobs(place.astype(np.int32), ends[to]).cast(pa.binary()),
                pa.array(split(names[doc]), pa.list_(pa.int64())),
                pa.array(split(part), pa.list_(pa.int32())),
            ],
            ["shard", "row", "ids", "cu_seqlens", "positions", "doc_ids", "parts"],
        )

    return pack


def token_pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, row_length: int = 2048, end_id: int = 50256, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packs all texts into rows of at most row_length token ids.

    Returns one row for each packed row: shard, row (its number in the shard), ids (4-byte token ids, one segment after
    the other), cu_seqlens (where each segment begins, and the end), positions (4 bytes each, beginning anew at 0 with
    each segment), doc_ids and parts (which document, and which piece of it, each segment is).
    Null and empty texts are an end mark alone. Null ids stay null; rows that repeat an id are packed each. An empty
    table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    shards = segments(text_bytes(docs), shard_bytes)
    dealt = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), "id", "text")
    return dealt.groupBy("shard").applyInArrow(_packer(vocabulary, row_length, end_id), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as files: id matrices, cumulative segment lengths and positions, as many files as the packing had tasks.

    The shard is a column, in whose order a file's rows are: its statistics find a shard without a folder for each.
    """
    packed.sortWithinPartitions("shard", "row").write.parquet(path)
