"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. What a line shows (letters, symbols, lengths and repeats of its words) and what the
lines before and after it show are weighed into its log odds; a table of transitions says how likely neighbours agree.
Forward and backward passes give each line's marginal probability of being good, and a document gets their mean, weighted
by the lines' lengths. All chains of a chunk are computed side by side: products of 2 x 2 matrices by doubling, so
that a text of a million lines takes twenty numpy steps.

Training maximises the likelihood of lines in numpy (Adam over all chains at once). Labels belong to documents, so each
line of a labelled document is taken as its document is labelled. Nothing but the text is seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.sample import bounded
from lociforge.llm.words import Words, bytes_of, chunks, mix

#: Labelled rows to train on, at most, and the most bytes of a text that is trained on (any text is scored whole).
TRAIN_ROWS, TRAIN_BYTES = 3000, 200_000
STEPS, RATE, DECAY, STICKY_DECAY = 250, 0.05, 1e-4, 1e-2

#: Classes of bytes: white space, capitals, small letters, beyond ASCII, digits, exclamation, bars, symbols, punctuation, rest.
SPACE, UPPER, LOWER, HIGH, DIGIT, BANG, BAR, SYMBOL, POINT, REST = range(10)
KIND = np.full(256, REST, np.int64)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x80:], KIND[0x30:0x3A] = UPPER, LOWER, HIGH, DIGIT
KIND[list(b"!")], KIND[list(b"|")], KIND[list(b"#*$%&<>@^~=+_{}[]\\/")], KIND[list(b".,;:?'\"()-")] = BANG, BAR, SYMBOL, POINT


class Lines:
    """The lines of a string column, and what each one shows."""

    def __init__(self, texts: pa.Array):
        data, rows = bytes_of(texts)
        breaks = np.flatnonzero(data == 0x0A)
        row = np.append(np.arange(len(rows) - 1), np.searchsorted(rows, breaks, "right") - 1)
        start = np.append(rows[:-1], breaks + 1)
        order = np.lexsort((start, row))
        self.row, start = row[order], start[order]
        #: Row r has the lines self.of[r] to self.of[r + 1].
        self.of = np.searchsorted(self.row, np.arange(len(rows)))
        last = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        end = np.where(last, rows[self.row + 1], np.append(start[1:], 0) - 1) if len(self.row) else start
        #: Bytes of each line.
        self.size = end - start
        self.shown = self._shown(Words(texts), data, start)

    def _shown(self, words: Words, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        n = len(self.row)
        line = lambda at: np.searchsorted(start, at, "right") - 1  # noqa: E731  empty lines at the end of a row begin where the next row does, which comes later
        where = np.repeat(np.arange(n), np.diff(np.append(start, len(data)))) if n else np.zeros(0, np.int64)
        kinds = np.bincount(where * 10 + KIND[data], minlength=10 * n).reshape(n, 10).astype(np.float64)
        of, h, length = line(words.starts), words.hashes(), words.ends - words.starts
        count = np.bincount(of, minlength=n).astype(np.float64)
        per_word, per_byte = 1 / np.maximum(count, 1), 1 / np.maximum(kinds[:, 1:].sum(1), 1)
        own = mix(h, of.astype(np.uint64))
        distinct = np.bincount(of[np.unique(own, return_index=True)[1]], minlength=n)
        again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(h) else np.zeros(n)
        odd = np.unique(np.searchsorted(words.starts, np.flatnonzero((KIND[data] == SYMBOL) | (KIND[data] == BAR)), "right") - 1)
        marked = np.bincount(of[odd], minlength=n)
        short = np.bincount(of[length <= 3], minlength=n)
        letters = np.maximum(kinds[:, UPPER] + kinds[:, LOWER], 1)
        head = np.searchsorted(of, np.arange(n))
        text = np.zeros(n, np.uint64)
        np.add.at(text, of, mix(h, (np.arange(len(h)) - head[of]).astype(np.uint64)))
        same = np.ones(n, bool)
        same[np.unique(mix(text, self.row.astype(np.uint64)), return_index=True)[1]] = False
        upper, short, marked, distinct = kinds[:, UPPER] / letters, short * per_word, marked * per_word, distinct * per_word
        enough = count >= 5
        shown = [
            np.log1p(self.size), np.log1p(count), count == 0, same & (count > 0), upper, kinds[:, HIGH] * per_byte, kinds[:, DIGIT] * per_byte, kinds[:, BANG] * per_byte, kinds[:, BAR] * per_byte,
            kinds[:, SYMBOL] * per_byte, kinds[:, POINT] * per_word, np.bincount(of, length, minlength=n) * per_word / 10, short, distinct, again * per_word, marked,
            (upper > 0.6) & (letters > 5), marked > 0.3, enough & (short < 0.12), enough & (short < 0.25), enough & (distinct < 0.3), enough & (distinct < 0.6), kinds[:, BANG] * per_word > 0.3,
        ]
        return np.stack([np.asarray(x, np.float64) for x in shown], 1)

    def features(self) -> np.ndarray:
        """What a line, the one before and the one after show; 0 beyond the ends of a text, which two flags tell."""
        first, last = np.zeros(len(self.row), bool), np.zeros(len(self.row), bool)
        some = self.of[:-1] < self.of[1:]
        first[self.of[:-1][some]] = last[self.of[1:][some] - 1] = True
        before, after = np.roll(self.shown, 1, 0), np.roll(self.shown, -1, 0)
        before[first], after[last] = 0, 0
        return np.concatenate([self.shown, before, after, first[:, None], last[:, None]], 1)


def products(m: np.ndarray, place: np.ndarray, back: bool = False) -> np.ndarray:
    """Running products of 2 x 2 matrices along chains, up to a factor; place: how many of its chain stand before each (behind it, if back)."""
    m = m.copy()
    step, longest = 1, int(place.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(place >= step)
        a, b = (m[at], m[at + step]) if back else (m[at - step], m[at])
        p = a[:, :, :1] * b[:, :1, :] + a[:, :, 1:] * b[:, 1:, :]
        m[at] = p / p.max((1, 2), keepdims=True)
        step *= 2
    return m


class Field:
    """w, b: a line's log odds of being good from its standardised features; t: log potentials of neighbours' states, s: of the first line's."""

    def __init__(self, n: int = 0):
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.p = {"w": np.zeros(n), "b": np.zeros(1), "t": np.zeros((2, 2)), "s": np.zeros(2)}

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p["w"] + self.p["b"][0], -25, 25)

    def marginals(self, odds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probabilities of (bad, good), and those of pairs with the line before it (0 for first lines)."""
        n = len(odds)
        size = np.diff(of)
        place = np.arange(n) - np.repeat(of[:-1], size)
        behind = np.repeat(size, size) - 1 - place
        state = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], 1)
        step = np.exp(self.p["t"] - self.p["t"].max())[None] * state[:, None, :]
        head = np.flatnonzero(place == 0)
        forth = step.copy()
        forth[head] = (np.exp(self.p["s"] - self.p["s"].max()) * state[head])[:, None, :]
        alpha = products(forth, place)[:, 0, :]
        back = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        inner = np.flatnonzero(behind > 0)
        back[inner] = step[inner + 1]
        beta = products(back, behind, back=True).sum(2)
        own = alpha * beta
        pair = np.zeros((n, 2, 2))
        later = np.flatnonzero(place > 0)
        pair[later] = alpha[later - 1][:, :, None] * step[later] * beta[later][:, None, :]
        norm = lambda a, axes: a / np.maximum(a.sum(axes, keepdims=True), 1e-300)
        return norm(own, 1), norm(pair, (1, 2))

    def slopes(self, x: np.ndarray, of: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the lines' log likelihood for standardised features x and the states `label`, summed."""
        odds = np.clip(x @ self.p["w"] + self.p["b"][0], -25, 25)
        one, pair = self.marginals(odds, of)
        off = label - one[:, 1]
        head = of[:-1][of[:-1] < of[1:]]
        later = np.ones(len(label), bool)
        later[head] = False
        later = np.flatnonzero(later)
        seen = np.bincount(label[later - 1] * 2 + label[later], minlength=4).reshape(2, 2)
        return {"w": x.T @ off, "b": np.array([off.sum()]), "t": seen - pair.sum(0), "s": np.bincount(label[head], minlength=2) - one[head].sum(0)}

    def train(self, texts: list[str], labels: np.ndarray) -> Field:
        if not len(texts):
            return self
        lines = Lines(pa.array(texts, pa.large_string()))
        x = lines.features()
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        label = np.asarray(labels, np.int64)[lines.row]
        m, s = ({k: np.zeros(v.shape) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, g in self.slopes(x, lines.of, label).items():
                g = g / len(label) - (DECAY if k in "wb" else STICKY_DECAY) * self.p[k]
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, lines: Lines) -> np.ndarray:
        """Each text's mean probability of good lines, weighted by their bytes and one more."""
        good = self.marginals(self.odds(lines.features()), lines.of)[0][:, 1]
        weight = lines.size + 1.0
        n = len(lines.of) - 1
        return np.bincount(lines.row, weight * good, n) / np.maximum(np.bincount(lines.row, weight, n), 1)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in chunks(batches):
            p = np.full(batch.num_rows, 0.5) if field is None else field.score(Lines(batch.column("text")))
            yield pa.record_batch([batch.column("id"), batch.column("held"), pa.array(np.clip(p, 0, 1))], ["id", "held", "score"])

    return score


def line_quality(df: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """Scores every text for quality; learns from at most train_rows labelled rows for which held_out is false.

    Returns for each row of df: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold). A null text counts as
    empty; an empty text is one empty line. Texts of any length are scored whole; those of more than TRAIN_BYTES bytes teach
    nothing, nor do rows with a null id, text or label; a row whose id has several labels teaches the largest, an id with
    several texts the least of them. A row for which held_out is null counts as not held out and teaches nothing. Rows that
    repeat an id are each scored. Without labels every score is 0.5. Columns of df and labels that clash with those named
    here are not read. An empty table gives an empty result.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out.alias("held"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    taught = docs.where(~F.col("held") & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    chosen = bounded(known.join(taught.select("id").distinct(), "id"), train_rows, "id")
    rows = taught.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("id").toPandas()
    field = Field(Lines(pa.array([""])).features().shape[1]).train(rows["text"].tolist(), (rows["label"] > 0).to_numpy(np.int64)) if len(rows) else None
    shared = df.sparkSession.sparkContext.broadcast(field)
    scored = docs.mapInArrow(_scorer(shared), "id bigint, held boolean, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce("held", F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
