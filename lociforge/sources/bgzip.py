"""Lines of block-gzipped files, each file read by many tasks.

A block-gzipped file is a row of small gzip members (64 KB of text at most) whose headers tell their own sizes. A task
takes a range of the compressed file: it looks for the first block that begins there, goes from block to block by their
sizes, and ends with the block before the next range's first. A line belongs to the range where it begins; one that
begins with the first byte of a range belongs to the range before it, whose task reads on to that line's end.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS by the address), as Spark's own readers take gzip whole.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, line string"
#: Compressed bytes of a range; text bytes of a batch; the longest block.
SPLIT_BYTES, BATCH_BYTES, BLOCK = 32 << 20, 4 << 20, 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


def block_size(data: bytes, at: int = 0) -> int | None:
    """Size of the block whose header begins at `at`, by the header's extra field BC; None if no such header is there."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    size = int.from_bytes(data[at + 10 : at + 12], "little")
    field, end = at + 12, at + 12 + size
    while field + 4 <= min(end, len(data)):
        n = int.from_bytes(data[field + 2 : field + 4], "little")
        if data[field : field + 2] == b"BC" and n == 2 and field + 6 <= len(data):
            return int.from_bytes(data[field + 4 : field + 6], "little") + 1
        field += 4 + n
    return None


def found_files(path: str) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
    """The files of a path: one file, those of a folder (but hidden ones), or those whose names match a pattern in its last part."""
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pa.fs.LocalFileSystem(), path)
    folder, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        files = [f for f in fs.get_file_info(pa.fs.FileSelector(folder or "/")) if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        info = fs.get_file_info(at)
        files = fs.get_file_info(pa.fs.FileSelector(at)) if info.type == pa.fs.FileType.Directory else [info]
    files = sorted((f for f in files if f.type == pa.fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)
    if not files:
        raise FileNotFoundError(path)
    return fs, files


def _first_block(f, start: int, size: int) -> int:
    """Where the first block at or after start begins; size, if none does. A header counts if the next block follows where it says."""
    if not start:
        return 0
    f.seek(start)
    data = f.read(3 * BLOCK)
    at = data.find(_MAGIC)
    while at >= 0:
        n = block_size(data, at)
        if n and (start + at + n == size or block_size(data, at + n)):
            return start + at
        at = data.find(_MAGIC, at + 1)
    if start + len(data) >= size:
        return size
    raise ValueError(f"no block begins in {3 * BLOCK} bytes from {start} on")


def blocks(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Text of the blocks from the first at or after start on, with the place where each begins; all that follow, beyond end, too."""
    at = _first_block(f, start, size)
    data, base = b"", at
    while at < size:
        if at + BLOCK > base + len(data) and base + len(data) < size:
            f.seek(at)
            data, base = f.read(max(BLOCK, min(16 * BLOCK, end - at))), at
        n = block_size(data, at - base)
        if not n or at + n > size:
            raise ValueError(f"not a block-gzipped file, or a broken one: no block at {at} of {size}")
        text = zlib.decompress(data[at - base : at - base + n], 31)
        yield at, text
        at += n


def range_lines(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """Runs of whole lines that begin in the range; none of them ends with a part of a line but the file's last."""
    rest, skipping = b"", start > 0
    for at, text in blocks(f, start, end, size):
        over = at >= end
        if skipping:
            cut = text.find(b"\n") + 1
            if not cut:
                if over:  # no line begins in this range
                    return
                continue
            if over:
                return
            text, skipping = text[cut:], False
        elif over:
            cut = text.find(b"\n") + 1
            if cut:
                yield rest + text[:cut]
                return
        rest += text
        if len(rest) >= BATCH_BYTES and not over:
            cut = rest.rfind(b"\n") + 1
            yield rest[:cut]
            rest = rest[cut:]
    if rest and not skipping:
        yield rest


def _batch(path: str, text: bytes) -> pa.RecordBatch:
    """Rows of lines without their ends (and without a carriage return before them)."""
    data = np.frombuffer(text if text.endswith(b"\n") else text + b"\n", np.uint8)
    end = np.flatnonzero(data == 0x0A)
    keep = np.ones(len(data), bool)
    keep[end] = False
    back = end[(end > 0)]
    keep[back[data[back - 1] == 0x0D] - 1] = False
    offsets = np.append(0, np.cumsum(keep)[end])
    lines = pa.Array.from_buffers(pa.string(), len(end), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[keep].tobytes())])
    return pa.record_batch([pa.array([path]).take(pa.array(np.zeros(len(end), np.int32))), lines], ["path", "line"])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        #: Only each file's first line that begins so is read, if this is given.
        self.header = options.get("header", "").encode()

    def partitions(self) -> list[Range]:
        _, files = found_files(self.path)
        return [Range(f.path, at, f.size if self.header else min(at + self.each, f.size), f.size) for f in files for at in range(0, max(f.size, 1), max(f.size, 1) if self.header else self.each)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (pa.fs.LocalFileSystem(), None)
        with fs.open_input_file(part.path) as f:
            if self.header:
                rest = b""
                for _, text in blocks(f, 0, BLOCK, part.size):
                    rest += text
                    at = 0 if rest.startswith(self.header) else rest.find(b"\n" + self.header) + 1
                    end = rest.find(b"\n", at)
                    if rest[at : at + len(self.header)] == self.header and end >= 0:
                        yield _batch(part.path, rest[at:end])
                        return
                    last = rest.rfind(b"\n")  # from the newline before the line that is not whole yet
                    rest = rest[last:] if last > 0 and not rest[at : at + len(self.header)] == self.header else rest
                return
            for text in range_lines(f, part.start, part.end, part.size):
                if text:
                    yield _batch(part.path, text)


class BlockGzipLines(DataSource):
    """spark.read.format("block_gzip_lines").load(path): path, line; options splitBytes and header."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
