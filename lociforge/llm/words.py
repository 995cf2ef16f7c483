"""Word kernels over Arrow string columns: numpy works on the column's bytes, never on single rows.

Words are runs of bytes that a 256-entry table accepts. UTF-8 multi-byte characters consist of bytes
from 0x80 up, so a byte table decides exactly what a character class over code points below 0x80 decides.
Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy step takes at a time; a longer single text is taken alone, whole.
CHUNK_BYTES = 3 << 20

#: Bytes of words that white space separates: all but 0x20 and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, a-z and everything beyond ASCII, for lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """An order-sensitive 64-bit mix of two hash arrays."""
    x = a * _A
    x ^= x >> np.uint64(32)
    x += b
    x *= _B
    x ^= x >> np.uint64(29)
    return x


class Words:
    """The words of a string column: byte ranges, 64-bit hashes, and the word range of each row."""

    def __init__(self, texts: pa.Array, table: np.ndarray = NON_SPACE, lower: bool = False):
        self.data, self.rows = bytes_of(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = table[self.data]
        first, last = inside.copy(), inside
        first[1:] &= ~inside[:-1]
        full = self.rows[:-1] < self.rows[1:]
        heads, tails = self.rows[:-1][full], self.rows[1:][full] - 1
        first[heads] = inside[heads]
        at_tail = inside[tails]
        last = np.append(inside[:-1] & ~inside[1:], inside[-1:]) if n else inside
        last[tails] = at_tail
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Row r has the words self.of[r] to self.of[r + 1].
        self.of = np.searchsorted(self.starts, self.rows)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts)

    def row_end(self) -> np.ndarray:
        """For each word, the word index at which its row ends."""
        return np.repeat(self.of[1:], self.counts)

    def hashes(self) -> np.ndarray:
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 8,), "<u8", padded, strides=(1,))
        left, at = self.ends - self.starts, self.starts
        h = left.astype(np.uint64)
        h *= _C
        h = mix(h, eight[at] & _LOW[np.minimum(left, 8)])
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        while len(more):
            h[more] = mix(h[more], eight[at] & _LOW[np.minimum(left, 8)])
            keep = left > 8
            more, at, left = more[keep], at[keep] + 8, left[keep] - 8
        return h

    def text(self, w: int) -> bytes:
        return self.data[self.starts[w] : self.ends[w]].tobytes()

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per row, the kept words joined by one space."""
        kept = np.flatnonzero(keep)
        total = np.concatenate(([0], np.cumsum(keep)))
        row_words = total[self.of]
        head = np.zeros(len(kept), bool)
        head[row_words[:-1][row_words[:-1] < row_words[1:]]] = True
        start, size = self.starts[kept], self.ends[kept] - self.starts[kept]
        size = size + ~head
        offset = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(offset[-1], dtype=np.int64)
        source += np.repeat(start - ~head - offset[:-1], size)
        out = self.data[np.maximum(source, 0)]
        out[offset[:-1][~head]] = 0x20
        return strings(out, offset[row_words])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) else pa.large_binary())
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[rows[0] : rows[-1]], rows - rows[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column: row r holds values[offsets[r]:offsets[r + 1]]."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(data.view(np.uint8))])


def unblob(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column and each row's offsets in them."""
    data, rows = bytes_of(column)
    return np.frombuffer(data.tobytes(), dtype), rows // np.dtype(dtype).itemsize


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: a run of n is two overlapping runs of at most n/2 rounded up."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        h = mix(h[: len(h) - step], h[step:])
        size += step
    return h


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most limit text bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto
        del batch
    tidy()


def tidy() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
