"""Toxicity scores from subword-bag embeddings.

A text is the bag of its distinct words, a word the bag of its character n-grams (3 to 5, with marks at its ends). The
n-grams' embeddings are averaged to words and these to the text, and a linear softmax reads the text's average. The
average over words is weighted: a word's weight is the exponential of a learned linear function of its own embedding, so
that a few words count in a long text, too, and harmless ones do not add up with its length. Embeddings, weights and
softmax are trained jointly by numpy; an unseen misspelling shares the vectors of the n-grams that it keeps. Training
knows labels of documents only. Scoring reads every word of the whole text; each distinct word of a chunk is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.sample import bounded
from lociforge.llm.words import ALNUM, Words, chunks, mix

#: Labelled rows to train on, at most.
TRAIN_ROWS = 3000
BUCKETS, DIM, EPOCHS, BATCH, RATE, DROP = 1 << 18, 8, 4, 64, 0.2, 0.3
GRAMS = (3, 4, 5)
#: Log odds before anything is learned.
PRIOR = -2.0

LETTERS = ALNUM.copy()
LETTERS[[0x24, 0x40]] = True  # $ and @ stand for letters in masked words


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts as n-gram buckets (grams, where each word's begin), and each text's word numbers (index, where each text's begin)."""
    words = Words(texts, LETTERS, lower=True)
    coded = pa.array(words.hashes()).dictionary_encode()
    index, n = coded.indices.to_numpy(), len(coded.dictionary)
    where = np.zeros(n, np.int64)
    where[index[::-1]] = np.arange(len(index))[::-1]
    size = words.ends[where] - words.starts[where] + 2
    of = np.append(0, np.cumsum(size))
    at = np.maximum(np.arange(of[-1]) + np.repeat(words.starts[where] - 1 - of[:-1], size), 0)
    data = words.data[np.minimum(at, max(len(words.data) - 1, 0))] if n else words.data[:0]
    data[of[:-1]], data[of[1:] - 1] = 0x3C, 0x3E
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin, end = np.flatnonzero(cps == 0x3C), np.flatnonzero(cps == 0x3E) + 1
    word_end = end.repeat(end - begin)
    word_of = np.arange(n).repeat(end - begin)
    grams, owner = [], []
    for k in GRAMS:
        h = np.full(max(len(cps) - k + 1, 0), k, np.uint64)
        for j in range(k):
            h = mix(h, cps[j : len(cps) - k + 1 + j])
        at = np.flatnonzero(np.arange(len(h)) + k <= word_end[: len(h)])
        grams.append((h[at] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word_of[at])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(n + 1)), index, words.of


def averages(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Mean of each run of values; 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    n = np.maximum(np.diff(of), 1)
    return (total[of[1:]] - total[of[:-1]]) / (n[:, None] if values.ndim > 1 else n)


def ranges(of: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of[k] to of[k + 1] of each chosen k one after the other, and where each one's begin."""
    size = of[chosen + 1] - of[chosen]
    ends = np.append(0, np.cumsum(size))
    return np.arange(ends[-1]) + (of[chosen] - ends[:-1]).repeat(size), ends


def pool(weight: np.ndarray, value: np.ndarray, doc: np.ndarray, word: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of each pair (doc, word) in its document, and each document's mean of the words' values by these shares."""
    top = np.full(docs, -np.inf)
    np.maximum.at(top, doc, weight[word])
    share = np.exp(weight[word] - top[doc])
    share /= np.bincount(doc, share, docs)[doc]
    return share, np.bincount(doc, share * value[word], docs)


def pairs_of(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, word), each once, from the word numbers of texts."""
    n = int(index.max()) + 1 if len(index) else 1
    pairs = np.unique(np.arange(len(rows) - 1).repeat(np.diff(rows)) * n + index)
    return pairs // n, pairs % n


class Model:
    """w: the softmax over both classes, v: what weights words, e: embeddings; Adagrad."""

    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.rng = rng
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.p = {"w": rng.normal(0, 0.3, (DIM, 2)), "b": np.array([0.0, PRIOR]), "v": np.zeros(DIM)}
        self.seen, self.squares = np.full(BUCKETS, 1e-8, np.float32), {k: np.full(v.shape, 1e-4) for k, v in self.p.items()}

    def gradient(self, x: np.ndarray, doc: np.ndarray, word: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Loss of documents given as pairs (doc, word) of words with embeddings x, and its slopes by x and by the parameters."""
        w, v, n = self.p["w"], self.p["v"], len(label)
        slope = w[:, 1] - w[:, 0]
        value = x @ slope
        share, mean = pool(x @ v, value, doc, word, n)
        z = np.clip(mean + self.p["b"][1] - self.p["b"][0], -30, 30)
        dz = 1 / (1 + np.exp(-z)) - label
        ds = np.bincount(word, share * dz[doc], len(x))
        da = np.bincount(word, share * (value[word] - mean[doc]) * dz[doc], len(x))
        g = x.T @ ds
        loss = float((np.log1p(np.exp(z)) - label * z).sum())
        return loss, ds[:, None] * slope + da[:, None] * v, {"w": np.stack([-g, g], 1), "v": x.T @ da, "b": np.array([-dz.sum(), dz.sum()])}

    def step(self, grams: np.ndarray, of: np.ndarray, doc: np.ndarray, word: np.ndarray, label: np.ndarray) -> None:
        """One step on documents: pairs (doc, word) of distinct words, and the words' n-grams, of which some are left out."""
        owner = np.arange(len(of) - 1).repeat(np.diff(of))
        keep = self.rng.random(len(grams)) >= DROP
        grams, owner = grams[keep], owner[keep]
        cut = np.searchsorted(owner, np.arange(len(of)))
        _, dx, slopes = self.gradient(averages(self.e[grams], cut), doc, word, label)
        dx /= np.maximum(np.diff(cut), 1)[:, None]
        seen, back = np.unique(grams, return_inverse=True)
        ge = np.stack([np.bincount(back, dx[owner, k], len(seen)) for k in range(DIM)], 1)
        self.seen[seen] += (ge**2).mean(1)
        self.e[seen] -= RATE * ge / np.sqrt(self.seen[seen])[:, None]
        for k, g in slopes.items():
            self.squares[k] += g**2
            self.p[k] -= RATE * 0.3 * g / np.sqrt(self.squares[k])

    def train(self, texts: list[str], labels: np.ndarray) -> Model:
        if not len(texts):
            return self
        grams, of, index, rows = bags(pa.array(texts, pa.large_string()))
        doc, word = pairs_of(index, rows)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        # few rows are gone through more often
        for _ in range(max(EPOCHS, min(40, 4 * TRAIN_ROWS // len(texts)))):
            order = self.rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                pairs, cut = ranges(first, chosen)
                used, place = np.unique(word[pairs], return_inverse=True)
                where, begin = ranges(of, used)
                self.step(grams[where], begin, np.arange(len(chosen)).repeat(np.diff(cut)), place, labels[chosen])
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What a bucket adds to a word's weight and to its log odds (both to be averaged), and the rest of the log odds."""
        w, v, b = self.p["w"], self.p["v"], self.p["b"]
        return (self.e @ v).astype(np.float32), (self.e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, value, rest = shared.value
        for batch in chunks(batches):
            grams, of, index, rows = bags(batch.column("text"))
            doc, word = pairs_of(index, rows)
            _, z = pool(averages(weight[grams], of), averages(value[grams], of), doc, word, batch.num_rows)
            p = np.where(np.diff(rows) > 0, 1 / (1 + np.exp(-np.clip(z + rest, -30, 30))), 0.0)
            yield pa.record_batch([batch.column("id"), batch.column("held"), pa.array(p)], ["id", "held", "score"])

    return score


def toxicity(df: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """Scores every text; learns from at most train_rows labelled rows for which held_out is false.

    Returns for each row of df: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold). Null texts and
    texts without words score 0. Rows with a null id, text or label teach nothing; a row whose id has several labels
    teaches the largest. Without labels scores stay low. A row for which
    held_out is null counts as not held out and teaches nothing. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = bounded(known.join(docs.where("not held").select("id").distinct(), "id"), train_rows, "id")
    rows = docs.where("not held and text is not null").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("id").toPandas()
    model = Model().train(rows["text"].tolist(), rows["label"].to_numpy(np.int64))
    shared = df.sparkSession.sparkContext.broadcast(model.weights())
    scored = docs.mapInArrow(_scorer(shared), "id bigint, held boolean, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce("held", F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
