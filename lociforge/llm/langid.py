"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions, across words, and labels every byte position with language
probabilities; a document gets their mean over all positions of its whole text. A text is read in windows of WINDOW
bytes, counted from its beginning. State begins anew CONTEXT bytes before each window (forwards) and CONTEXT bytes
after it (backwards), so any number of windows are computed side by side, however long a text is, and a position's
label depends on its text alone. Beyond the ends of a text the network reads blanks.

Training is numpy backpropagation through time on windows drawn from a bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.sample import bounded
from lociforge.llm.words import LOWER, bytes_of, chunks

#: Documents to train on, at most.
TRAIN_ROWS = 1000
HIDDEN, STEPS, BATCH, RATE = 12, 250, 128, 0.02
WINDOW, CONTEXT = 224, 16
#: Bytes of a window that is trained on, and how many windows are computed side by side.
TRAIN_BYTES, WIDTH = 64, 1024
SPACE = 0x20


def read(data: np.ndarray, start: np.ndarray, length: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes at start to start + length, a column for each; blanks outside of first to end."""
    at = start + np.arange(length)[:, None]
    return np.where((at >= first) & (at < end), data[np.clip(at, 0, max(len(data) - 1, 0))], SPACE).astype(np.uint8)


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over both states at every position.

    Sequences are columns. In arrays with a direction, step t of the backward one is at position T - 1 - t.
    """

    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.rng = rng
        # x: input table, a column for each byte and direction; u: recurrent weights; gates in the order update, reset, candidate
        self.p = {"x": normal(3 * HIDDEN, 512), "u": normal(2, 3 * HIDDEN, HIDDEN), "c": np.zeros((2, 3 * HIDDEN, 1), np.float32)}
        self.p |= {"o": normal(2, classes, HIDDEN), "oc": np.zeros((classes, 1), np.float32)}

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, direction, unit, sequence) of bytes x (position, sequence)."""
        steps, n = x.shape
        dtype, half = self.p["u"].dtype, np.ones((3 * HIDDEN, 1), self.p["u"].dtype)
        half[: 2 * HIDDEN] = 0.5  # the sigmoid of gates by tanh
        table = ((self.p["x"].reshape(-1, 2, 256) + self.p["c"].transpose(1, 0, 2)).reshape(-1, 512) * half).T.copy()
        u = self.p["u"] * half
        index = np.concatenate([x, x[::-1].astype(np.intp) + 256], 1)
        out, r = np.empty((steps, 2, HIDDEN, n), dtype), np.empty((2, 3 * HIDDEN, n), dtype)
        h = np.zeros((2, HIDDEN, n), dtype)
        for t in range(steps):
            a = table[index[t]].reshape(2, n, -1).transpose(0, 2, 1)
            np.matmul(u, h, out=r)
            g, m = r[:, : 2 * HIDDEN], r[:, 2 * HIDDEN :]
            g += a[:, : 2 * HIDDEN]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            rm = m.copy() if keep is not None else None
            m *= g[:, HIDDEN:]
            m += a[:, 2 * HIDDEN :]
            np.tanh(m, out=m)
            if keep is not None:
                keep.append((h, g[:, :HIDDEN].copy(), g[:, HIDDEN:].copy(), m.copy(), rm))
            new = out[t]
            np.subtract(h, m, out=new)
            new *= g[:, :HIDDEN]
            new += m
            h = new
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Language probabilities (position, language, sequence)."""
        y = self.p["o"][0] @ states[:, 0]
        y += self.p["o"][1] @ states[::-1, 1]
        y += self.p["oc"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def totals(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each text (row r is data[rows[r]:rows[r + 1]]) the sum of its positions' language probabilities."""
        size = np.diff(rows)
        many = -(-size // WINDOW)
        row = np.arange(len(size)).repeat(many)
        start = rows[:-1][row] + (np.arange(len(row)) - (np.cumsum(many) - many)[row]) * WINDOW
        length = np.minimum(rows[1:][row] - start, WINDOW)
        width = -(-length // 32) * 32
        out = np.zeros((len(size), len(self.p["oc"])))
        for w in np.unique(width):
            here = np.flatnonzero(width == w)
            for at in range(0, len(here), WIDTH):
                part = here[at : at + WIDTH]
                # the context behind a short window is read behind its end, in place of the width's
                x = read(data, start[part] - CONTEXT, int(w) + 2 * CONTEXT, rows[:-1][row[part]], np.minimum(rows[1:][row[part]], start[part] + length[part] + CONTEXT))
                p = self.labels(self.states(x))[CONTEXT : CONTEXT + int(w)]
                p *= (np.arange(int(w))[:, None] < length[part])[:, None, :]
                for c, total in enumerate(p.sum(0, dtype=np.float64)):
                    out[:, c] += np.bincount(row[part], total, len(size))
        return out

    def gradient(self, x: np.ndarray, label: np.ndarray, here: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean loss over the positions that `here` marks; label: a language for each sequence."""
        kept: list = []
        states = self.states(x, kept)
        p = self.labels(states)
        p[:, label, np.arange(x.shape[1])] -= 1
        p *= (here / max(here.sum(), 1))[:, None, :].astype(p.dtype)
        both = np.stack([p, p[::-1]], 1)  # (step, direction, language, sequence)
        g = {"o": np.einsum("tdlb,tdhb->dlh", both, states, optimize=True), "oc": p.sum((0, 2))[:, None]}
        back = self.p["o"].transpose(0, 2, 1) @ both
        u, dh, inputs = self.p["u"], np.zeros_like(states[0]), np.empty((len(x), 2, 3 * HIDDEN, x.shape[1]), p.dtype)
        gu = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            h, z, reset, m, rm = kept[t]
            dh = dh + back[t]
            dm = dh * (1 - z) * (1 - m * m)
            gates = [dh * (h - m) * z * (1 - z), dm * rm * reset * (1 - reset)]
            inputs[t] = np.concatenate([*gates, dm], 1)
            ds = np.concatenate([*gates, dm * reset], 1)
            gu += ds @ h.transpose(0, 2, 1)
            dh = dh * z + u.transpose(0, 2, 1) @ ds
        which = np.stack([x, x[::-1].astype(np.intp) + 256], 1).ravel()
        gx = np.stack([np.bincount(which, inputs[:, :, k].ravel(), 512) for k in range(3 * HIDDEN)])
        return g | {"u": gu, "x": gx, "c": inputs.sum((0, 3))[:, :, None]}

    def train(self, data: np.ndarray, rows: np.ndarray, label: np.ndarray) -> Network:
        """Adam on windows of texts: each language is drawn by the root of its share, a text and a place in it evenly."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        many = np.bincount(label, minlength=len(self.p["oc"]))
        share = np.cumsum(many[label] ** -0.5 / (many[label] ** -0.5).sum())
        for step in range(1, STEPS + 1):
            row = np.minimum(np.searchsorted(share, self.rng.random(BATCH)), len(label) - 1)
            first, end = rows[row], rows[row + 1]
            start = first + (self.rng.random(BATCH) * np.maximum(end - first - TRAIN_BYTES // 2, 1)).astype(np.int64)
            x = read(data, start, TRAIN_BYTES, first, end)
            here = start + np.arange(TRAIN_BYTES)[:, None] < end
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, v in self.gradient(x, label[row], here).items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def learn(texts: list[str], langs: list[str]) -> tuple[list[str], Network | None]:
    """The languages, in order, and the network that tells them apart; texts without a byte teach nothing."""
    kept = [(t, v) for t, v in zip(texts, langs, strict=True) if t]
    names = sorted({v for _, v in kept})
    if not names:
        return names, None
    data, rows = bytes_of(pa.array([t for t, _ in kept], pa.large_string()))
    return names, Network(len(names)).train(LOWER[data], rows, np.array([names.index(v) for _, v in kept]))


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, network = shared.value
        for batch in chunks(batches):
            data, rows = bytes_of(batch.column("text"))
            data = LOWER[data]
            total = network.totals(data, rows) if network is not None else np.zeros((batch.num_rows, 1))
            best = total.argmax(1)
            latin = np.append(0, np.cumsum((data >= 0x61) & (data <= 0x7A)))
            letters = np.diff(latin[rows]) > 0
            for r in np.flatnonzero(~letters & (np.diff(rows) > 0)):
                letters[r] = any(map(str.isalpha, batch.column("text")[int(r)].as_py() or ""))
            known = letters & (total.sum(1) > 0)
            lang = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, total[np.arange(len(best)), best] / np.maximum(np.diff(rows), 1), 0.0)
            yield pa.record_batch([batch.column("id"), batch.column("held"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["id", "held", "lang_pred", "score"])

    return predict


def language_id(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Predicts the language of every text; learns from at most train_rows rows with a language for which held_out is false.

    Returns for each row: id_col, held_out, lang_pred (a learned language; 'und' if the text is null, has no letter, or
    nothing could be learned), score (the mean probability of lang_pred over all positions; 0 for 'und'). Rows with a null
    id, text or language teach nothing, nor do those for which held_out is null, which count as not held out; rows that
    repeat an id are each predicted. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = docs.where("not held and id is not null and text is not null and lang is not null")
    rows = bounded(known, train_rows, "id").select("id", "text", "lang").orderBy("id", "text").toPandas()
    shared = df.sparkSession.sparkContext.broadcast(learn(rows["text"].tolist(), rows["lang"].tolist()))
    out = docs.select("id", "held", "text").mapInArrow(_predictor(shared), "id bigint, held boolean, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce("held", F.lit(False)).alias("held_out"), "lang_pred", "score")
