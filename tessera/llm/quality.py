"""A quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages of PASSAGE words. Each passage is encoded from counts of its words' kinds and shapes, from
repeats within it and within the document; gated attention gives passages weights that sum to one over the document, and the
weighted sum of their encodings is scored. Only documents have labels; the attention is learned from them. The model is fitted
on a bounded sample of labelled documents and applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, with_text
from .near import mixed
from .pieces import chunks

PASSAGE = 64
SHAPES = 24
CACHED_WORDS = 100_000
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
HIDDEN = 16


#: Classes of bytes: lower-case and beyond ASCII, upper case, digits, marks, others.
LOWER, UPPER, DIGIT, MARK, SIGN = range(5)
CLASSES = np.full(256, SIGN, np.uint8)
CLASSES[[*range(97, 123), *range(128, 256)]] = LOWER
CLASSES[65:91] = UPPER
CLASSES[48:58] = DIGIT
CLASSES[[ord(c) for c in ".,;:!?"]] = MARK


def kinds(words: list[bytes]) -> np.ndarray:
    """Of each word: 1, size, shares of letters, upper case, digits, marks and others, whether it is long, short, all upper case,
    without letters; and its shape's place among SHAPES, by a hash of its bytes with runs of letters or digits as one."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    of = CLASSES[raw]
    lower, upper, digits, marks = (np.add.reduceat((of == k).astype(np.int32), begin) for k in (LOWER, UPPER, DIGIT, MARK))
    letters = lower + upper
    out = np.zeros((len(words), 11 + SHAPES), np.float32)
    out[:, 0], out[:, 1], out[:, 7], out[:, 8], out[:, 9], out[:, 10] = 1, size, size > 14, size <= 2, upper == size, letters == 0
    for k, x in enumerate((letters, upper, digits, marks, size - letters - digits - marks)):
        out[:, 2 + k] = x / size
    shape = np.where(of < MARK, of, raw).astype(np.uint64) + np.uint64(1)
    starts = np.zeros(len(raw), bool)
    starts[begin] = True
    kept = starts | (of >= MARK)
    kept[1:] |= of[1:] != of[:-1]
    at = np.cumsum(kept) - 1
    first = at[begin]
    place = np.arange(at[-1] + 1) - np.repeat(first, np.diff(np.append(first, at[-1] + 1)))
    hashed = np.add.reduceat(mixed(shape[kept] * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), first)
    out[np.arange(len(words)), 11 + (mixed(hashed) % np.uint64(SHAPES)).astype(np.int64)] = 1
    return out


WIDTH = 11 + SHAPES + 5


def first_seen(marks: np.ndarray) -> np.ndarray:
    """Which marks have no equal before them, by their upper bits, with places in the lower: one sort of numbers."""
    bits = np.uint64(max(1, (len(marks) - 1).bit_length()))
    keys = np.sort((marks >> bits << bits) | np.arange(len(marks), dtype=np.uint64))
    top = keys >> bits
    new = np.ones(len(keys), bool)
    new[1:] = top[1:] != top[:-1]
    out = np.zeros(len(marks), bool)
    out[(keys[new] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return out


class Passages:
    """Encodes texts: a row of WIDTH numbers for each passage."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows, self.used = np.zeros((1024, 11 + SHAPES), np.float32), 0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All passages, and where each text's start; an empty text has one passage without words."""
        split = [(t or "").encode().split() for t in texts]
        words = [w for s in split for w in s]
        if self.used > CACHED_WORDS:
            self.start()
        if new := list(set(words).difference(self.at)):
            self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = kinds(new)
            self.used += len(new)
        n = np.fromiter(map(len, split), np.int64, len(split))
        many = np.maximum(1, -(-n // PASSAGE))
        first = np.cumsum(many) - many
        out = np.zeros((many.sum(), WIDTH), np.float32)
        if not words:
            return out, first
        which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        passage = first[doc] + at // PASSAGE
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        rows = passage[begin]
        size = np.diff(np.append(begin, len(words)))
        total = np.add.reduceat(self.rows[which], begin)
        out[rows, : 11 + SHAPES] = total / size[:, None]
        out[rows, 0] = np.log1p(size)
        share = lambda flag: np.add.reduceat(flag.astype(np.float32), begin) / size
        h = mixed(which.astype(np.uint64) + np.uint64(1))
        same = np.zeros(len(words), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[rows, -5] = share(same)
        four = h * np.uint64(3)  # runs of four words; beyond a text's end there are none
        for i, factor in ((1, 5), (2, 7), (3, 11)):
            four += np.where(at + i < n[doc], np.roll(h, -i), np.uint64(0)) * np.uint64(factor)
        for g, place, own in ((h, -4, passage), (h, -3, doc), (four, -2, doc)):  # distinct words of the passage; new words and new runs of four of the document
            out[rows, place] = share(first_seen(mixed(g ^ mixed(own.astype(np.uint64) + np.uint64(1 << 40)))))  # numbers that no word has
        out[rows, -1] = np.log1p(n[doc[begin]])
        return out, first


@dataclass
class Model:
    """x -> tanh: encodings; attention by tanh and sigmoid gates; logistic score of the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        w, b, v, u, a, c, d = self.weights
        n = np.diff(np.append(first, len(x)))
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        att = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(att[:, None] * h, first)
        return h, t, g, att, z, 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(self.normal(x), first)[-1]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, c, d = self.weights
        n = np.diff(np.append(first, len(x)))
        h, t, g, att, z, s = self.forward(x, first)
        dl = (s - y) / len(y)
        dz = np.repeat(dl[:, None] * c, n, 0)
        da = (dz * h).sum(1)
        de = att * (da - np.repeat(np.add.reduceat(att * da, first), n))
        dtg = de[:, None] * a
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (att[:, None] * dz + dt @ v.T + dg @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dl, np.array([dl.sum()])]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on batches of documents."""
    rng = np.random.default_rng(seed)
    model = Model(x.mean(0), np.maximum(x.std(0), 1e-3), [rng.normal(0, s**-0.5, shape) for s, shape in ((WIDTH, (WIDTH, HIDDEN)), (1, (HIDDEN,)), (HIDDEN, (HIDDEN, HIDDEN)), (HIDDEN, (HIDDEN, HIDDEN)), (HIDDEN, (HIDDEN,)), (HIDDEN, (HIDDEN,)), (1, (1,)))])
    model.weights[1][:], model.weights[6][:] = 0, 0
    x = model.normal(x).astype(float)
    n = np.diff(np.append(first, len(x)))
    m, s, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            rows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in own])
            step += 1
            for k, grad in enumerate(model.gradients(x[rows], np.cumsum(n[own]) - n[own], y[own])):
                grad = grad + decay * model.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                model.weights[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """From at most ``sample`` labelled documents whose crc32 of the id as text isn't 0 modulo ``folds``, the first by a hash of their
    ids. Null labels and ids don't count, and of an id's labels the lowest does. Without any label each score is 1/2."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, folds) != 0))
    some = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").orderBy("id", F.xxhash64("text")).limit(2 * sample).collect()
    if not rows:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros(s) for s in ((WIDTH, HIDDEN), HIDDEN, (HIDDEN, HIDDEN), (HIDDEN, HIDDEN), HIDDEN, HIDDEN, 1)])
    passages, parts = Passages(), []
    for texts in chunks(r["text"] for r in rows):
        parts.append(passages(texts))
    x = np.concatenate([p[0] for p in parts])
    before = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
    first = np.concatenate([p[1] + n for p, n in zip(parts, before, strict=True)])
    return train(x, first, np.array([float(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """Per row: ``id_col`` (or the columns ``kept``), score: 0 to 1, higher where label 1 is likelier.

    A null or empty text is one passage without words, and has a score. Rows count each, whatever their ids; only ``text_col`` is
    an input of the score. An empty table gives no rows; ``kept`` may have columns of any name but "score".
    """
    kept = kept or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, kept, strict=True)] + [T.StructField("score", T.DoubleType())])

    rows, at = with_text(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, own = Passages(), shared.value
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(at).to_pylist()):
                s = own.scores(*passages(texts))
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(texts)) for c in batch.columns[: len(kept)]), pa.array(s.astype(float))], schema.names)
                done += len(texts)

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, kept, strict=True)))
