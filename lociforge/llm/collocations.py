"""Phrase collocation mining: phrases whose words stand together more often than their parts let expect.

Counts are exact and of each language's own. No phrase can be frequent unless its words are, so:

1. Chunks of texts are cut into pieces and words, each chunk with a vocabulary of its own, which it sends, with counts, in
   packed parts to segments by the hash of words. A segment sums the counts over the corpus, numbers the words that are
   frequent in their language (the dictionary) and answers each chunk with the numbers of those that it has.
2. What is not in the dictionary breaks a chunk's pieces, as punctuation does. At every place that is left, the numbers of
   the next words (five for the longest phrases, fewer before a break) are a key of fixed width. Equal keys sort next to each other, and so do all keys that begin with the same shorter phrase: one order
   serves the phrases of all lengths. A chunk sorts its keys (radix, 16 bits at a time) and keeps each once, with its count.
3. A thin, even sample of all chunks' keys gives the bounds of key ranges. Chunks send each range a slice of theirs; a
   range merges what it gets by another radix sort and counts runs: each run of keys with the same first k numbers is a
   phrase of k words. Runs at the ends of a range may go on in the next, and are summed by phrase.
4. The frequent phrases that are left are joined with their own parts for scores.

A word or phrase that stands everywhere takes one entry of each chunk. Bounds of ranges are sent to all tasks: 20 bytes
for each RANGE_KEYS keys (3 million words of text or more), a millionth of the text. Words of a chunk are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.llm.store import segments, text_bytes, written
from lociforge.llm.words import Words, chunks, mix, tidy

#: Text bytes for each segment of the dictionary.
SEGMENT_BYTES = 32 << 20
#: Text bytes of a chunk, keys of a range at most and at least (if there are tasks to spare), keys for each one of the sample.
CHUNK_BYTES, RANGE_KEYS, LEAST_KEYS, SAMPLE_EVERY = 8 << 20, 3_000_000, 100_000, 1024
LONGEST = 5

#: What ends a piece, and words: all but these, space and tab.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

#: A chunk: its codes, its languages, and its vocabulary, a part for each segment (words, one a line; their places, languages and counts).
_PART = pa.struct([("segment", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("n_codes", pa.int64()), ("codes", pa.binary()), ("langs", pa.list_(pa.string())), ("parts", pa.list_(_PART))])
_CHUNK_SQL = "chunk bigint, n_codes bigint, codes binary, langs array<string>, parts array<struct<segment:bigint,size:bigint,words:binary,numbers:binary>>"
#: What a segment tells: of a frequent word (its number as key); of a language, all words' count; of a chunk, which of its words are frequent (their places and numbers).
_TOLD = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("key", pa.binary()), ("chunk", pa.int64()), ("size", pa.int64()), ("known", pa.binary())])
_TOLD_SQL = "lang string, word string, n bigint, key binary, chunk bigint, size bigint, known binary"
_RUN_SQL = "n_keys bigint, keys binary, sample array<binary>"
_SLICE_SQL = "range bigint, n_keys bigint, keys binary"
_COUNT_SQL = "key binary, a bigint"


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit numbers, by planes of their bytes, compressed."""
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns]
    return pa.Codec("zstd").compress(np.ascontiguousarray(np.stack(planes)).tobytes(), asbytes=True)


def unpack(blob: bytes, n: int, k: int) -> np.ndarray:
    """k columns of n numbers."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * n * k), np.uint8).reshape(k, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(k, n)


def radix_order(columns: np.ndarray) -> np.ndarray:
    """The order of rows by their columns, the first one first: a radix sort by 16 bits, the last digits first."""
    order = None
    for c in columns[::-1]:
        for digit in (c.astype(np.uint16), (c >> np.uint32(16)).astype(np.uint16)):
            if order is None:
                order = np.argsort(digit, kind="stable")
            elif digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(columns: np.ndarray, k: int) -> np.ndarray:
    """Where sorted rows begin to differ from the one before in the first k columns."""
    if not columns.shape[1]:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, (columns[:k, 1:] != columns[:k, :-1]).any(0)))


def binary(columns: np.ndarray) -> np.ndarray:
    """Rows as binary keys, four bytes a column, in the order of the numbers."""
    return np.ascontiguousarray(columns.T.astype(">u4")).view(f"S{4 * len(columns)}").ravel()


def _keys(keys: np.ndarray) -> pa.Array:
    """A binary column of keys of one width."""
    width, n = keys.dtype.itemsize, len(keys)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _encode(limit: int, n_segments: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with their vocabularies; a code is twice the word's place there, and one more if a piece begins."""
        task, serial = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, limit=limit):
            words = Words(batch.column("text"), WORD, lower=True)
            if not len(words):
                continue
            langs = batch.column("lang").dictionary_encode()
            row = words.row_of()
            lang = langs.indices.to_numpy()[row].astype(np.int64)
            breaks = np.append(0, np.cumsum(BREAK[words.data], dtype=np.int32))
            begins = np.append(True, (row[1:] != row[:-1]) | (breaks[words.starts[1:]] > breaks[words.ends[:-1]]))
            _, at, code, n = np.unique(mix(words.hashes(), lang.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
            often = np.argsort(-n, kind="stable")  # frequent words get small codes
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            at, n = at[often], n[often]
            codes = pack([place[code] * 2 + begins])
            segment = (words.hashes()[at] % np.uint64(n_segments)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            cut = np.flatnonzero(np.append(True, segment[order][1:] != segment[order][:-1]))
            data, parts = words.data.tobytes(), []
            for of in np.split(order, cut[1:]):
                spelt = b"\n".join([data[a:b] for a, b in zip(words.starts[at[of]].tolist(), words.ends[at[of]].tolist(), strict=True)])
                parts.append({"segment": int(segment[of[0]]), "size": len(of), "words": spelt, "numbers": pack([of, lang[at[of]], n[of]])})
            row = {"chunk": (task << 32) + serial, "n_codes": len(code), "codes": codes, "langs": langs.dictionary.to_pylist(), "parts": parts}
            yield pa.RecordBatch.from_pylist([row], schema=_CHUNK)
            serial += 1
            del words, row, data, parts, code, codes, begins, breaks, lang
            tidy()

    return encode


def _dictionary(least: int, n_segments: int):
    """A segment: its chunks' words in; frequent words with numbers, languages' totals and answers to chunks out."""

    def number(table: pa.Table) -> pa.Table:
        words, places, langs, counts, sizes = [], [], [], [], table.column("size").to_pylist()
        spoken = table.column("langs").to_pylist()
        names = pa.array([x for langs in spoken for x in langs], pa.string()).dictionary_encode()
        first = np.append(0, np.cumsum([len(x) for x in spoken]))
        coded = names.indices.to_numpy()
        for r, size in enumerate(sizes):
            words += table.column("words")[r].as_py().split(b"\n")
            place, lang, n = unpack(table.column("numbers")[r].as_py(), size, 3)
            places.append(place)
            langs.append(coded[first[r] + lang])
            counts.append(n)
        spelt = pa.array(words, pa.binary()).dictionary_encode()
        lang, count = np.concatenate(langs).astype(np.int64), np.concatenate(counts).astype(np.int64)
        _, at, which = np.unique(spelt.indices.to_numpy().astype(np.int64) * len(names.dictionary) + lang, return_index=True, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, which, count)
        frequent = total >= least
        ids = np.where(frequent, (np.cumsum(frequent) - 1) * n_segments + table.column("segment")[0].as_py() + 1, 0)
        if ids.max() >= 1 << 32:
            raise ValueError("more than 4 billion words are frequent: a key has four bytes for each")
        id_of, found = ids[which], at[frequent]
        by_lang = np.zeros(len(names.dictionary), np.int64)
        np.add.at(by_lang, lang, count)
        ends = np.append(0, np.cumsum(sizes))
        answers = [(c, id_of[a:b] > 0, p, id_of[a:b]) for c, a, b, p in zip(table.column("chunk").to_pylist(), ends[:-1], ends[1:], places, strict=True)]
        answers = [(c, int(k.sum()), pack([p[k], i[k]])) for c, k, p, i in answers if k.any()]
        told = lambda rows, **columns: pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _TOLD], schema=_TOLD)
        return pa.concat_tables([
            told(len(found), lang=names.dictionary.take(pa.array(lang[found])), word=spelt.dictionary.take(spelt.indices.take(pa.array(found))), n=pa.array(total[frequent]), key=_keys(binary(ids[frequent][None]))),
            told(len(by_lang), lang=names.dictionary, n=pa.array(by_lang)),
            told(len(answers), chunk=pa.array([c for c, _, _ in answers], pa.int64()), size=pa.array([n for _, n, _ in answers], pa.int64()), known=pa.array([b for _, _, b in answers], pa.binary())),
        ])

    return number


def windows(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The next LONGEST ids at every place with two at least, a column for each; 0 from the end of a piece, or from a 0, on."""
    n = len(ids)
    out = np.zeros((LONGEST, n), np.uint32)
    out[0] = ids
    for k in range(1, LONGEST):
        out[k, : n - k] = np.where((out[k - 1, : n - k] > 0) & ~begins[k:], ids[k:], 0)
    return out[:, (out[0] > 0) & (out[1] > 0)]


def _sorted_keys(every: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's keys in order, once each, with counts, and every `every`-th of them."""
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column("n_codes")[r].as_py()
                codes = unpack(batch.column("codes")[r].as_py(), n, 1)[0].astype(np.int64)
                places, ids = np.concatenate([unpack(x["known"], x["size"], 2) for x in batch.column("answers")[r].as_py()], 1)
                id_of = np.zeros(int(codes.max()) // 2 + 1, np.uint32)
                id_of[places] = ids
                # numbers of this chunk, in the order of their ids, need fewer digits
                own = np.append(0, np.sort(ids)).astype(np.uint32)
                local = np.searchsorted(own, id_of).astype(np.uint32)
                columns = windows(local[codes >> 1], (codes & 1).astype(bool))
                if not columns.shape[1]:
                    continue
                columns = columns[:, radix_order(columns)]
                head = runs(columns, LONGEST)
                counts = np.diff(np.append(head, columns.shape[1]))
                columns = own[columns[:, head]]
                sample = _keys(binary(columns[:, every // 2 :: every]))
                yield pa.record_batch([pa.array([len(head)]), pa.array([pack([*columns, counts])], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(sample)], pa.int32()), sample)], ["n_keys", "keys", "sample"])
                del columns, counts, head, codes
                tidy()

    return sort


def _slices(shared):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column("n_keys")[r].as_py()
                columns = unpack(batch.column("keys")[r].as_py(), n, LONGEST + 1)
                of = np.searchsorted(bounds, binary(columns[:LONGEST]), "right")
                head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                ends = np.append(head[1:], n)
                yield pa.record_batch([pa.array(of[head].astype(np.int64)), pa.array(ends - head), pa.array([pack(list(columns[:, a:b])) for a, b in zip(head, ends, strict=True)], pa.binary())], ["range", "n_keys", "keys"])

    return deal


def _counted(least: int):
    def count(table: pa.Table) -> pa.Table:
        parts = [unpack(blob.as_py(), n.as_py(), LONGEST + 1) for blob, n in zip(table.column("keys"), table.column("n_keys"), strict=True)]
        columns = np.concatenate(parts, 1)
        del parts
        columns = columns[:, radix_order(columns[:LONGEST])]
        tidy()
        counts, n = columns[LONGEST].astype(np.int64), columns.shape[1]
        keys, sums = [], []
        for k in range(2, LONGEST + 1):
            head = runs(columns, k)
            total = np.add.reduceat(counts, head)
            some = columns[k - 1, head] > 0
            # the first and the last run may have more keys in the next ranges
            open_end = (head == 0) | (np.append(head[1:], n) == n)
            chosen = some & (open_end | (total >= least))
            keys.append(_keys(binary(columns[:k, head[chosen]])))
            sums.append(total[chosen])
        del columns, counts, head, total
        tidy()
        return pa.table([pa.chunked_array(keys, pa.binary()).combine_chunks(), pa.array(np.concatenate(sums))], ["key", "a"])

    return count


def _picked(every: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = every // 2
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % every, batch.num_rows, every)))
            seen += batch.num_rows

    return pick


def phrase_counts(encoded: DataFrame, answers: DataFrame, least: int) -> DataFrame:
    """key, a: phrases of 2 to LONGEST words of the dictionary that are found least times or more; key: their words' keys joined."""
    spark = encoded.sparkSession
    known = answers.groupBy("chunk").agg(F.collect_list(F.struct("size", "known")).alias("answers"))
    keyed = written(encoded.select("chunk", "n_codes", "codes").join(known.hint("shuffle_hash"), "chunk").select("n_codes", "codes", "answers").mapInArrow(_sorted_keys(SAMPLE_EVERY), _RUN_SQL), "none")
    n_keys = keyed.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first().n
    n_ranges = max(-(-n_keys // RANGE_KEYS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // LEAST_KEYS), 1)
    sample = keyed.select(F.explode("sample").alias("key"))
    every = max(1, n_keys // SAMPLE_EVERY // n_ranges)
    picked = sample.repartitionByRange(max(1, n_ranges // 256), "key").sortWithinPartitions("key").mapInArrow(_picked(every), "key binary").toArrow().column("key") if n_ranges > 1 else []
    bounds = np.unique(np.array([k.as_py() for k in picked], f"S{4 * LONGEST}"))
    slices = keyed.select("n_keys", "keys").mapInArrow(_slices(spark.sparkContext.broadcast(bounds)), _SLICE_SQL)
    found = slices.groupBy("range").applyInArrow(_counted(least), _COUNT_SQL)
    return found.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _part(start, size):
    """Words start (from 0) to start + size of a key."""
    return F.substring("key", 4 * start + 1, 4 * size)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000, percent: int = 100) -> DataFrame:
    """The first `top` phrases of every language: contiguous runs of 2 to 5 words inside a piece, found `least` times or more.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line breaks (0x0A-0x0D), and pieces into words at spaces
    and tabs. n: all words of the language; a: places of the phrase; for a cut into two parts, found l and r times, the
    score is floor(1000 a n / (l r)); the lowest of all cuts counts, of equal ones that with the shorter first part. A phrase
    is left out if a longer one that contains it is found at least percent / 100 times as often. Order: score, a (both
    descending), phrase. Returns lang, rank, phrase, a, l, r, n, score. Arithmetic is that of decimals of 38 digits.

    A null language is 'und'; null and empty texts have no words. Rows are counted as often as they stand in the table. Texts
    of any length are read whole, a long one as a chunk of its own. Other columns are not read. An empty table gives an empty result.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    n_segments = segments(text_bytes(docs), SEGMENT_BYTES)
    encoded = written(docs.mapInArrow(_encode(CHUNK_BYTES, n_segments), _CHUNK_SQL), "zstd")
    parts = encoded.select("chunk", "langs", F.inline("parts"))
    told = written(parts.groupBy("segment").applyInArrow(_dictionary(least, n_segments), _TOLD_SQL))
    words = told.where("key is not null").select("lang", "word", "n", "key")
    totals = told.where("key is null and lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = written(phrase_counts(encoded, told.where("chunk is not null").select("chunk", "size", "known"), least))

    k = F.octet_length("key") / 4
    found = words.select("key", F.col("n").alias("f")).unionByName(phrases.select("key", F.col("a").alias("f")))
    cuts = phrases.withColumn("k", k.cast("int")).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select("*", _part(F.lit(0), F.col("cut")).alias("first"), _part(F.col("cut"), F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(found.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(found.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = written(cuts.select("key", "k", "cut", "a", "first", "rest", "l", "r"))
    # a phrase that holds a dropped one and one word more is found as often or more than any longer one around both
    inside = cuts.where("cut = k - 1 and k > 2").select(F.col("first").alias("key"), F.col("l").alias("f"), "a").unionByName(cuts.where("cut = 1 and k > 2").select(F.col("rest").alias("key"), F.col("r").alias("f"), "a"))
    dropped = inside.where(F.lit(100) * F.col("a") >= F.lit(percent) * F.col("f")).select("key").distinct()

    of = words.select(F.col("key").alias("head"), "lang").join(totals, "lang")
    scored = cuts.join(dropped, "key", "left_anti").withColumn("head", F.substring("key", 1, 4)).join(of, "head")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    scored = scored.withColumn("score", F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("key", "lang", "n", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("key", "lang", "n", "a", "b.score", "b.l", "b.r")
    order = [F.col("score").desc(), F.col("a").desc()]
    near = best.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    spelt = near.withColumn("k", k.cast("int")).select("*", F.posexplode(F.expr("transform(sequence(0, k - 1), i -> substring(key, 4 * i + 1, 4))")).alias("place", "head"))
    spelt = spelt.join(words.select(F.col("key").alias("head"), "word"), "head").groupBy("lang", "key", "a", "l", "r", "n", "score")
    named = spelt.agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "word")))["word"], " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
