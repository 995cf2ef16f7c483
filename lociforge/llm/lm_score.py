"""Language-model scores from a log-frequency Bloom filter.

Counts of single words and of word pairs in the training documents are quantised on a logarithmic scale
(q = 1 + floor(log_base count)); the filter holds an n-gram under each of the levels 1 to q, and a lookup
probes level after level until one is missing. Errors are one-sided: a count is never too small by more than
its quantisation step, and is too large as often as unrelated bits happen to be set.

How the counts are gathered: a map task reduces each chunk of documents to its distinct n-grams with counts and
sends them, packed, to the segments of a hash space. A segment sums them, sets the bits of its own slice of the
filter, and answers each chunk with the exact counts of the chunk's words, from which the exact add-one unigram
score (base_score) is summed, and with the levels under which its slice holds the chunk's words and pairs. A word in
every document so costs one entry a chunk, and neither vocabulary nor filter is held in one place. A slice has
SLICE_BITS bits for each one that is set in it, so its rate of errors is the same at every size of the input.

The slices are kept, in a table: `learn` returns them as a model, which scores texts that it has not seen by probes
alone, no count being left but the two totals. Slices go to the workers that ask them by segment, each as often as
needed for a bounded number of questions at a time: as the filter grows with the corpus, no worker gets all of it.

The model: p(w | u) = (c(u, w) + weight * p(w)) / (c(u) + weight) with p(w) = (c(w) + 1) / (N + V + 1), u being the
word before w (an end mark at the start of a text), all c from the filter.
N-grams are told apart by 64-bit hashes (pairs inside a segment by 32 further bits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import segments, text_bytes, written
from lociforge.llm.words import Words, blobs, chunks, mix, tidy, unblob

#: Bits of a slice of the filter for each bit that is set: 8 % are set, and an n-gram that is missing passes 0.6 % of the levels.
SLICE_BITS = 12
#: Probes for each level, base of the quantisation, and weight of the single-word probability.
PROBES, BASE, WEIGHT = 2, 1.5, 10.0
SEGMENT_BYTES = 4 << 20
END = np.uint64(0x5DEECE66D1234567)
_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

CHUNK = "chunk bigint, ids array<bigint>, held array<boolean>, words binary, sizes binary, sequence binary"
SENT = "segment int, chunk bigint, words binary, counts binary, pairs binary, pair_counts binary"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, an end mark after each, and where each text begins."""
    words = Words(texts, lower=True)
    of = words.of + np.arange(len(words.of))
    h = np.full(of[-1], END)
    keep = np.ones(len(h), bool)
    keep[of[1:] - 1] = False
    h[keep] = words.hashes()
    return h, of


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before it; the first of a text follows the end mark of the one before."""
    return mix(np.append(END, h[:-1]), h)


def _prints(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A fingerprint of each token sequence."""
    x = h * (np.arange(len(h)) - of[:-1].repeat(np.diff(of))).astype(np.uint64).__mul__(np.uint64(2)).__add__(np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(31)
    return np.add.reduceat(x, of[:-1]).astype(np.int64) if len(of) > 1 else np.zeros(0, np.int64)


def _by_segment(keys: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct keys by segment and size, and where each segment begins in it."""
    segment = (keys % np.uint64(n_segments)).astype(np.int64)
    order = np.lexsort((keys, segment))
    return order, np.searchsorted(segment[order], np.arange(n_segments + 1))


def _planes(x: np.ndarray) -> bytes:
    """Four-byte numbers as four planes of bytes: those of small numbers are mostly 0 and take little space."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _coder(n_segments: int):
    """Documents to chunks: their distinct words, and the token sequences as places in these."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, of = _tokens(batch.column("text"))
            coded = pa.array(h).dictionary_encode()
            keys, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            order, _ = _by_segment(keys, n_segments)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            prints = _prints(h, of)
            chunk = int(mix(prints.astype(np.uint64), np.uint64(len(prints))).sum(dtype=np.uint64).astype(np.int64))
            one = lambda x: pa.array([x], pa.binary())
            ids, held = pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([batch.column("held").to_pylist()], pa.list_(pa.bool_()))
            yield pa.record_batch([pa.array([chunk]), ids, held, one(keys[order].tobytes()), one(np.diff(of).astype(np.uint32).tobytes()), one(_planes(place[index]))], [x.split()[0] for x in CHUNK.split(", ")])

    return code


def _sender(n_segments: int):
    """A chunk's n-grams with their counts, to the segments."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, held, words, sizes, sequence = (batch.column(c)[row] for c in ("chunk", "held", "words", "sizes", "sequence"))
                keys, sequence = np.frombuffer(words.as_py(), np.uint64), _unplanes(sequence.as_py())
                train = (~held.values.fill_null(True).to_numpy(zero_copy_only=False)).repeat(np.frombuffer(sizes.as_py(), np.uint32))
                _, cut = _by_segment(keys, n_segments)
                counts = np.bincount(sequence[train], minlength=len(keys))
                # pairs that nothing is learned from are sent, too, with a count of 0: they want an answer
                pairs, of_pair = np.unique(_pairs(keys[sequence]), return_inverse=True)
                order, pair_cut = _by_segment(pairs, n_segments)
                pairs, many = pairs[order], np.bincount(of_pair[train], minlength=len(pairs))[order]
                packed = [
                    blobs(keys, cut),
                    blobs(counts.astype(np.uint32), cut),
                    blobs((pairs >> np.uint64(32)).astype(np.uint32), pair_cut),
                    blobs(many.astype(np.uint32), pair_cut),
                ]
                out = pa.record_batch([pa.array(np.arange(n_segments, dtype=np.int32)), pa.array(np.full(n_segments, chunk.as_py())), *(x.cast(pa.binary()) for x in packed)], [x.split()[0] for x in SENT.split(", ")])
                yield out.filter(pa.array((np.diff(cut) > 0) | (np.diff(pair_cut) > 0)))
        tidy()

    return send


def _bits(keys: np.ndarray, kind: np.uint64, level: int, probe: int, size: int) -> np.ndarray:
    return mix(keys, kind + np.uint64(level * PROBES + probe)) % np.uint64(size)


class Filter:
    """Packed slices of the filter, one after the other."""

    def __init__(self, slices: np.ndarray, n_segments: int, slice_bits: int):
        self.slices, self.n, self.size = slices, np.uint64(n_segments), slice_bits

    def levels(self, hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
        """The last level that each n-gram is found under, 0 for those that are not found."""
        at = (hashes % self.n) * np.uint64(self.size)
        keys = hashes if kind == _WORD else hashes >> np.uint64(32)
        q, live, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
        while len(live):
            for probe in range(PROBES):
                bit = at[live] + _bits(keys[live], kind, level, probe, self.size)
                live = live[(self.slices[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0]
            q[live] = level
            level += 1
        return q

    def counts(self, hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
        """Middle of the quantisation step that each n-gram is found under, 0 for those that are not found."""
        return middles(self.levels(hashes, kind))


def middles(q: np.ndarray) -> np.ndarray:
    """Middle of each level's quantisation step, 0 for level 0."""
    steps = np.arange(int(q.max()) + 1 if len(q) else 1)
    low, high = np.ceil(BASE ** (steps - 1.0) - 1e-9), np.ceil(BASE**steps - 1e-9) - 1
    return np.where(steps > 0, (low + np.maximum(high, low)) / 2, 0)[q]


def slice_filter(*grams: tuple[np.ndarray, np.ndarray, np.uint64]) -> Filter:
    """A segment's slice, as large as what (keys, counts, kind) set in it needs."""
    found = []
    for keys, counts, kind in grams:
        keys, counts = keys[counts > 0], counts[counts > 0]
        found.append((keys, (1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9)).astype(np.int64), kind))
    size = max(1 << 10, -(-SLICE_BITS * PROBES * sum(int(q.sum()) for _, q, _ in found) // 8) * 8)
    bits = np.zeros(size, bool)
    for keys, q, kind in found:
        level = 1
        while len(keys):
            for probe in range(PROBES):
                bits[_bits(keys, kind, level, probe, size)] = True
            level += 1
            keys, q = keys[q >= level], q[q >= level]
    return Filter(np.packbits(bits), 1, size)


def _segment(table: pa.Table) -> pa.Table:
    """A segment's share: answers to chunks (counts and levels of their n-grams), its part of N and V."""
    table = table.combine_chunks()
    segment = table.column("segment")[0].as_py()
    keys, of = unblob(table.column("words"), np.uint64)
    counts, _ = unblob(table.column("counts"), np.uint32)
    coded = pa.array(keys).dictionary_encode()
    words, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    total = np.bincount(index, counts, len(words)).astype(np.int64)
    pairs, of_pairs = unblob(table.column("pairs"), np.uint32)
    pair_counts, _ = unblob(table.column("pair_counts"), np.uint32)
    coded_pairs = pa.array(pairs).dictionary_encode()
    pairs, pair_index = coded_pairs.dictionary.to_numpy().astype(np.uint64), coded_pairs.indices.to_numpy()
    table_of = slice_filter((words, total, _WORD), (pairs, np.bincount(pair_index, pair_counts, len(pairs)), _PAIR))
    levels = table_of.levels(words, _WORD).astype(np.uint8)[index]
    pair_levels = table_of.levels(pairs << np.uint64(32), _PAIR).astype(np.uint8)[pair_index]
    n = table.num_rows
    binary = lambda x, rows: blobs(x, rows).cast(pa.binary())
    answers = pa.table({"chunk": table.column("chunk"), "counts": binary(total[index], of), "levels": binary(levels, of), "pair_levels": binary(pair_levels, of_pairs), "segment": pa.array(np.full(n, segment, np.int32)), "n": pa.nulls(n, pa.int64()), "v": pa.nulls(n, pa.int64()), "slice": pa.nulls(n, pa.binary())})
    own = pa.table({"chunk": pa.nulls(1, pa.int64()), **{c: pa.nulls(1, pa.binary()) for c in ("counts", "levels", "pair_levels")}, "segment": pa.array([segment], pa.int32()), "n": pa.array([int(total.sum())]), "v": pa.array([int((total > 0).sum())]), "slice": pa.array([table_of.slices.tobytes()], pa.binary())})
    return pa.concat_tables([answers, own])


ANSWERED = "chunk bigint, counts binary, levels binary, pair_levels binary, segment int, n bigint, v bigint, slice binary"
PROBED = "chunk bigint, counts binary, levels binary, pair_levels binary, segment int"


def _probed(sent: pa.Table, slices: pa.Table) -> pa.Table:
    """A kept slice's answers to the chunks of texts that nothing is learned from; a segment without a slice knows no n-gram."""
    keys, of = unblob(sent.column("words"), np.uint64)
    pairs, of_pairs = unblob(sent.column("pairs"), np.uint32)
    levels, pair_levels = np.zeros(len(keys), np.uint8), np.zeros(len(pairs), np.uint8)
    if slices.num_rows:
        bits = np.frombuffer(slices.column("slice")[0].as_py(), np.uint8)
        table = Filter(bits, 1, 8 * len(bits))
        levels, pair_levels = table.levels(keys, _WORD).astype(np.uint8), table.levels(pairs.astype(np.uint64) << np.uint64(32), _PAIR).astype(np.uint8)
    binary = lambda x, rows: blobs(x, rows).cast(pa.binary())
    return pa.table({"chunk": sent.column("chunk"), "counts": binary((levels > 0).astype(np.int64), of), "levels": binary(levels, of), "pair_levels": binary(pair_levels, of_pairs), "segment": sent.column("segment")})
SCORED = "id bigint, held boolean, n_tokens bigint, n_known bigint, base double, score double"


def _scores(n_segments: int, total: int):
    """Scores of the documents of one chunk: its token sequences, and what all segments answered."""

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        segment = table.column("segment").to_numpy()
        answers = {}
        for row in np.flatnonzero(segment >= 0):
            answers[segment[row]] = int(row)

        def answer(column: str, dtype) -> np.ndarray:
            return np.concatenate([np.frombuffer(table.column(column)[answers[s]].as_py(), dtype) for s in sorted(answers)])

        counts, single, pair = answer("counts", np.int64), middles(answer("levels", np.uint8)), middles(answer("pair_levels", np.uint8))
        out = []
        for row in np.flatnonzero(segment < 0):
            words, ids, held, sizes, sequence = (table.column(c)[int(row)] for c in ("words", "ids", "held", "sizes", "sequence"))
            sizes = np.frombuffer(sizes.as_py(), np.uint32).astype(np.int64)
            sequence = _unplanes(sequence.as_py())
            at = np.cumsum(sizes) - sizes
            c = counts[sequence]
            base = np.add.reduceat(np.log10(c + 1.0), at) - sizes * math.log10(total)
            known = np.add.reduceat(c > 0, at, dtype=np.int64)
            pairs, of_pair = np.unique(_pairs(np.frombuffer(words.as_py(), np.uint64)[sequence]), return_inverse=True)
            both = np.empty(len(pairs))
            both[_by_segment(pairs, n_segments)[0]] = pair
            c = single[sequence]
            before = np.append(c[-1:], c[:-1])  # the last token is an end mark, as is what precedes the first
            p = (np.minimum(both[of_pair], before) + WEIGHT * (c + 1) / total) / (before + WEIGHT)
            out.append(pa.table([ids.values, held.values, pa.array(sizes), pa.array(known), pa.array(base), pa.array(np.add.reduceat(np.log10(p), at))], ["id", "held", "n_tokens", "n_known", "base", "score"]))
        return pa.concat_tables(out)

    return score


class Learned(NamedTuple):
    """A filter in slices (reduced), its totals, and the corpus that it was learned from, coded."""

    coded: DataFrame
    reduced: DataFrame
    n_segments: int
    n: int
    v: int

    def slices(self) -> DataFrame:
        """(segment, slice): the filter. A segment of the hash space that no n-gram fell into has no slice."""
        return self.reduced.where("slice is not null").select("segment", "slice")

    def _scored(self, coded: DataFrame, answers: DataFrame) -> DataFrame:
        parts = coded.withColumn("segment", F.lit(-1)).unionByName(answers.select("segment", "chunk", "counts", "levels", "pair_levels"), allowMissingColumns=True)
        return parts.groupBy("chunk").applyInArrow(_scores(self.n_segments, self.n + self.v + 1), SCORED)

    def own(self) -> DataFrame:
        """Scores of the corpus itself, with its exact counts for the base score."""
        return self._scored(self.coded, self.reduced.where("chunk is not null"))

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, n_tokens, n_known, score) of any texts, from the filter alone: n_known are the tokens that it finds.

        Null texts count as empty. Rows that repeat an id each get their result, other columns are left out.
        """
        docs = df.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("held"), F.col(text_col).alias("text"))
        # texts may be more than what was learned from: a segment's questions are dealt to as many copies of its slice
        copies = max(1, -(-text_bytes(docs) // (self.n_segments * SEGMENT_BYTES)))
        coded = written(docs.mapInArrow(_coder(self.n_segments), CHUNK), "zstd")
        asked = coded.mapInArrow(_sender(self.n_segments), SENT).withColumn("copy", F.pmod(F.xxhash64("chunk"), F.lit(copies)))
        slices = self.slices().withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        answers = asked.groupBy("segment", "copy").cogroup(slices.groupBy("segment", "copy")).applyInArrow(_probed, PROBED)
        return self._scored(coded, written(answers, "zstd")).select(F.col("id").alias(id_col), "n_tokens", "n_known", "score")


def learn(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Learned:
    """The filter of the texts of df for which held_out is false, in a table of the shared folder."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    n_segments = segments(text_bytes(docs), SEGMENT_BYTES)
    coded = written(docs.mapInArrow(_coder(n_segments), CHUNK), "zstd")
    reduced = written(coded.mapInArrow(_sender(n_segments), SENT).groupBy("segment").applyInArrow(_segment, ANSWERED), "zstd")
    total = reduced.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return Learned(coded, reduced, n_segments, total.n, total.v)


def lm_score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text by a language model learned from the rows for which held_out is false.

    Tokens are words without white space, A-Z lower-cased, then one end mark. Returns for each row: id_col, held_out,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigram, exact), score (the model's
    log10 probability). Null texts count as empty: one token. Rows for which held_out is null are scored, not learned
    from. Rows that repeat an id and a text each get their result. A text longer than a chunk is a chunk of its own, whole.
    Other columns of df, whatever their names, are left out. An empty table gives an empty result.
    """
    learned = learn(df, held_out, id_col, text_col)
    return learned.own().select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(learned.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
