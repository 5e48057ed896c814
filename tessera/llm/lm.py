"""An n-gram language model with Katz backoff, learned from some documents and applied to all of them.

Seen n-grams have Good-Turing discounted counts; a context's weight gives unseen words what that leaves, in proportion to
their probability of the next lower order, so that each context's probabilities sum to one over the vocabulary and one unknown word:

    P(w | h) = d(r) * r / c(h)          where h w was seen r times
             = alpha(h) * P(w | h')     else, h' being h without its first word; alpha(h) = (1 - sum of P(seen | h)) / (1 - sum of P(seen | h'))

A context that was never seen has alpha(h) = 1. Counts above MOST are left whole, as Katz has it; where a context has only such
counts, one is added to c(h), and unseen words share it.

Texts are tokenised once, in chunks that are written as a table. For each order, a chunk asks the buckets of its distinct n-grams
for their counts, and sends what it has of them; a bucket, about a million n-grams of chunks, sums them, writes contexts with their words
and counts as a table of the model, and replies. There are as many buckets as the number of tokens asks for. A context that holds more
than a quarter of a bucket is split by the word after it, and its parts are summed by themselves. With all replies a chunk
evaluates each of its tokens from the lowest order up, as the next order backs off to it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, new_path, partitions, written
from .near import BLOBS, Words, blobs, chunked, mixed, rows_of, squeezed, unsqueezed

#: Counts up to this are discounted by Good-Turing.
MOST = 5
END = 1  # the hash of a text's end
SHIFT = np.uint64(8)  # hashes of 56 bits
BITS = 56
#: Places for ids that are no word's: what was not seen in training, and what is before a text.
UNKNOWN, START = -1, -2
TINY = 1e-300
#: N-grams of chunks that one bucket has, at most; words of a chunk.
BUCKET, CHUNK = 1_000_000, 1_000_000


def discounts(n: list[int]) -> list[float]:
    """Factors for counts 1 to MOST from the numbers n[r] of things seen r times, r to MOST + 1.

    Katz's formula is applied to the numbers as they are, and, if that gives a factor that isn't between 0 and 1 (copies of
    documents make them uneven), to numbers smoothed by a line through their logarithms; else all are (r - 1/2) / r.
    """

    def katz(n: list[float]) -> list[float]:
        top = (MOST + 1) * n[MOST + 1] / n[1]
        return [((r + 1) * n[r + 1] / (n[r] * r) - top) / (1 - top) for r in range(1, MOST + 1)]

    known = [r for r in range(1, MOST + 2) if n[r] > 0]
    tries = [n] if len(known) == MOST + 1 else []
    if len(known) > 1:
        slope, level = np.polyfit(np.log(known), np.log([n[r] for r in known]), 1)
        tries.append([0.0, *(float(np.exp(level + slope * np.log(r))) for r in range(1, MOST + 2))])
    for own in tries:
        d = katz(own) if own[1] != (MOST + 1) * own[MOST + 1] else [1.0]
        if all(0 < x < 1 for x in d):
            return d
    return [(r - 0.5) / r for r in range(1, MOST + 1)]


def kept(d: tuple[float, ...], r: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.array([0.0, *d, 1.0])[np.minimum(r, MOST + 1)] * r


@dataclass(frozen=True)
class Unigrams:
    """Numbers of training tokens, distinct words and documents, and what gives P(w) by w's count."""

    tokens: int
    words: int
    documents: int
    d: tuple[float, ...]
    total: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, documents: int, n: list[int], words: int) -> Unigrams:
        d = discounts(n)
        left = sum(n[r] * r * (1 - d[r - 1]) for r in range(1, MOST + 1))
        total = tokens if left else tokens + 1
        return cls(tokens, words, documents, tuple(d), float(total), (left or 1) / total)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, kept(self.d, c) / self.total, self.unknown)


def left_of(d: tuple[float, ...], n: list[np.ndarray]) -> np.ndarray:
    """What discounts take from contexts' counts, from n[r - 1] words seen r times after them."""
    return sum((1 - d[r]) * (r + 1) * n[r] for r in range(MOST))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, start) if len(start) else x[:0]


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


CHUNKS = "chunk long, info binary, words binary, tokens binary, n_words long, n_tokens long, trained long, documents long"


def tokenized(df: DataFrame, folds: int) -> DataFrame:
    """Chunks of (id, text): info (ids, which are held out, numbers of tokens), words (hashes of distinct ones, ascending, with their
    numbers in training), tokens (each one's rank by frequency; each text ends with END; and the places of ranks in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, c = Words(), TaskContext.get().partitionId(), 0
        for ids, texts in chunked(batches, CHUNK):
            split = [(t or "").encode().lower().split() for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split)) + 1
            w = np.full(n.sum(), END, np.uint64)
            inner = np.ones(len(w), bool)
            inner[np.cumsum(n) - 1] = False
            w[inner] = (hashes([x for s in split for x in s]) >> SHIFT) | np.uint64(4)
            del split
            held = np.array([folds > 0 and zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids])
            w, place, many = np.unique(w, return_inverse=True, return_counts=True)
            order = np.argsort(-many, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            trained = ~np.repeat(held, n)
            learned = np.bincount(place[trained], minlength=len(w)).astype(np.uint32)
            place = rank[place]
            info = pa.BufferOutputStream()
            table = pa.table({"id": pa.array(ids), "held": held, "n": n})
            with pa.ipc.new_stream(info, table.schema) as out:
                out.write_table(table)
            row = [task << 24 | c, info.getvalue().to_pybytes(), squeezed(w, learned), squeezed(place.astype(np.uint32), order.astype(np.uint32)), len(w), len(place), int(trained.sum()), int((~held).sum())]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in CHUNKS.split(", ")])
            c += 1

    return df.mapInArrow(run, CHUNKS)


#: What buckets make. REPLIES go to chunks; NUMBERS are of n-grams by count; GRAMS are contexts with the words seen after them, their counts,
#: and the sum of their lower probabilities; ASKED are split contexts that a chunk needs.
REPLIES, NUMBERS, GRAMS, ASKED = "replies", "numbers", "grams", "asked"
LONGS = T.ArrayType(T.LongType(), False)
MET = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("context", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("split", T.BooleanType()), T.StructField("lower", T.DoubleType()), T.StructField("words", LONGS), T.StructField("counts", LONGS), T.StructField("ids", LONGS),
])
ARROW = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("context", pa.int64()), ("total", pa.int64()), ("split", pa.bool_()), ("lower", pa.float64()),
    *[(c, pa.list_(pa.field("element", pa.int64(), False))) for c in ("words", "counts", "ids")],
])


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int64)))


def met(kind: str, n: int, **columns: object) -> pa.Table:
    own = {"kind": pa.array([kind] * n, pa.string()), **columns}
    arrays = []
    for f in ARROW:
        x = own.get(f.name)
        x = pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type)
        arrays.append(x.cast(f.type))
    return pa.Table.from_arrays(arrays, schema=ARROW)


def asked_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's distinct words, by ranges of their hashes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, n = unsqueezed(data)
                yield blobs(w, [n], buckets, chunk, None, BITS)

    return chunks.select("chunk", "words").mapInArrow(send, BLOBS)


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Counts of words by ranges of their hashes: a word's id is its rank in its bucket times ``buckets``, plus the bucket."""

    def count(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        bucket, own = rows[0]["bucket"], [unsqueezed(r["data"]) for r in rows]
        w, which = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        c = np.bincount(which, np.concatenate([x[1] for x in own]), len(w)).astype(np.int64)
        rank = np.empty_like(c)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(c))  # so that frequent words have small ids
        replies, at = [], 0
        for x in own:
            i = which[at : at + len(x[0])]
            at += len(i)
            replies.append(squeezed(c[i], rank[i].astype(np.uint32)))
        seen = c > 0
        return pa.concat_tables([
            met(REPLIES, len(rows), chunk=[r["chunk"] for r in rows], bucket=[bucket] * len(rows), data=replies),
            met(NUMBERS, 1, counts=[np.bincount(np.minimum(c[seen], MOST + 2), minlength=MOST + 3).tolist()]),
            met(GRAMS, 1, bucket=[bucket], words=lists(w[seen], np.array([seen.sum()])), counts=lists(c[seen], np.array([seen.sum()])), ids=lists(rank[seen] * buckets + bucket, np.array([seen.sum()]))),
        ])

    return asked_words(chunks, buckets).groupBy("bucket").applyInArrow(count, MET)


@dataclass(frozen=True)
class Order:
    """What is known of an order: its buckets and discounts."""

    buckets: int
    d: tuple[float, ...] = ()


class Chunk:
    """A chunk's tokens, and what the orders' replies say of them."""

    def __init__(self, table: pa.Table, uni: Unigrams, orders: list[Order]):
        self.uni, self.orders, self.table = uni, orders, table
        row = self.part(0)[0]
        self.chunk, self.info = row["chunk"], row["info"]
        place, order = (x.astype(np.int64) for x in unsqueezed(row["data"]))
        replies = [(r["bucket"], *unsqueezed(r["data"])) for r in sorted(self.part(1), key=lambda r: r["bucket"])]
        c = joined([x[1] for x in replies])[order]
        ids = joined([x[2].astype(np.int64) * orders[0].buckets + x[0] for x in replies])[order]
        ids[c == 0] = UNKNOWN
        self.c, self.ids = c[place], ids[place]
        self.first = np.append(True, order[place[:-1]] == 0)  # after an END, whose hash is the least
        self.count = self.c  # of the n-gram of the last order that ends at a token
        self.log = np.log10(uni.p(self.c))  # of the probability of the last order
        self.key = np.zeros(len(place), np.uint64)  # of the context of the last order
        self.before = self.ids
        self.total = np.zeros(len(place), np.int64)  # what the lower order's counts are divided by

    def part(self, kind: int) -> list[dict]:
        import pyarrow.compute as pc

        return rows_of(self.table.filter(pc.equal(self.table.column("part"), kind)))

    def grams(self, k: int) -> None:
        """Distinct n-grams of order k, in the order in which they are sent, and which of them each token ends."""
        self.before = np.append(START, self.before[:-1])
        self.before[self.first] = START
        self.key = (self.before + 3).astype(np.uint64) if k == 2 else mixed(self.key * np.uint64(0x9E3779B97F4A7C15) + (self.before + 3).astype(np.uint64)) >> np.uint64(1)
        seen = np.append(0, self.count[:-1])  # how often the context was
        seen[self.first] = self.uni.documents
        self.seen = seen
        asks = np.flatnonzero(seen > 0)
        words = np.where(self.count[asks] > 0, self.ids[asks], UNKNOWN)
        key, context = np.unique(self.key[asks], return_inverse=True)
        word, short = np.unique(words, return_inverse=True)
        pair, gram = np.unique(context.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64), return_inverse=True)
        some = np.zeros(len(pair), np.int64)
        some[gram] = asks  # a token that ends it
        key, word = key[(pair >> np.uint64(32)).astype(np.int64)], word[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        parts = -(-4 * seen[some] // BUCKET)
        of = np.where((parts > 1) & (word >= 0), mixed(word.astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64), 0).astype(np.uint64)
        bucket = (mixed(key * np.uint64(0xD6E8FEB86659FD93) + of) % np.uint64(self.orders[k - 1].buckets)).astype(np.int64)
        order = np.lexsort((word, key, bucket))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.asks, self.gram = asks, rank[gram]
        self.sent_bucket, self.sent_key, self.sent_word, self.sent_token, self.split = bucket[order], key[order], word[order], some[order], parts[order] > 1

    def ask(self, k: int, trained: np.ndarray) -> list[tuple[int, bytes]]:
        """What goes to each bucket of order k."""
        self.grams(k)
        learned = np.bincount(self.gram[trained[self.asks]], minlength=len(self.sent_key))
        valid, start = self.sent_word >= 0, runs(self.sent_bucket, self.sent_key)
        out = []
        edges = [*runs(self.sent_bucket[start]).tolist(), len(start)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x, y = start[a], start[b] if b < len(start) else len(self.sent_key)
            own, head = np.flatnonzero(valid[x:y]) + x, start[a:b]
            followers = summed(valid[x:y].astype(np.uint32), head - x).astype(np.uint32)
            word, first, short = np.unique(self.sent_word[own], return_index=True, return_inverse=True)
            token = self.sent_token[head]
            before = self.count[self.sent_token[own]]  # of the lower order: for words alone once a word
            data = squeezed(
                self.sent_key[head], followers, self.seen[token], self.total[token] if k > 2 else self.total[:0], self.split[head], ~valid[head],
                word.astype(np.uint64), short.astype(np.uint16 if len(word) < 1 << 16 else np.uint32), learned[own].astype(np.uint32), before if k > 2 else before[first],
            )
            out.append((int(self.sent_bucket[x]), data))
        return out

    def hear(self, k: int) -> None:
        """Takes the replies of order k: counts, and probabilities."""
        self.grams(k)
        replies = [unsqueezed(r["data"]) for r in sorted(self.part(k), key=lambda r: r["bucket"])]
        valid, start = self.sent_word >= 0, runs(self.sent_bucket, self.sent_key)
        r = np.zeros(len(self.sent_key), np.int64)
        r[valid] = joined([x[0] for x in replies])
        needed = np.flatnonzero(np.logical_or.reduceat(r == 0, start)) if len(start) else start  # contexts of unseen words
        d, seen, split = self.orders[k - 1].d, self.seen[self.sent_token[start]], self.split[start]
        whole = joined([x[1] for x in replies], bool)  # none of the context's counts is discounted: one more is left to unseen words
        left, lower = left_of(d, [joined([x[2 + i] for x in replies]) for i in range(MOST)]), joined([x[2 + MOST] for x in replies], np.float64)
        if split.any():  # of these a bucket has only a part
            rows = sorted(self.part(-k), key=lambda x: x["context"])
            known = np.array([x["context"] for x in rows], np.uint64)
            taken, sums = np.array([x["taken"] for x in rows]), np.array([x["lower"] for x in rows])
            whole[split] = taken[np.searchsorted(known, self.sent_key[start[split]])] == 0
            at = np.searchsorted(known, self.sent_key[start[needed[split[needed]]]])
            left[split[needed]], lower[split[needed]] = taken[at], sums[at]
        total, alpha = seen + whole, np.zeros(len(start))
        alpha[needed] = np.log10(np.where(whole[needed], 1, left) / np.maximum(total[needed], 1)) - np.log10(np.maximum(1 - lower, self.uni.unknown if k == 2 else TINY))
        size = np.diff(np.append(start, len(r)))
        own, a, t = r[self.gram], np.repeat(alpha, size)[self.gram], np.repeat(total, size)[self.gram]
        log, count, totals = self.log.copy(), np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        with np.errstate(divide="ignore"):
            log[self.asks] = np.where(own > 0, np.log10(kept(d, own)) - np.log10(t), a + self.log[self.asks])
        count[self.asks], totals[self.asks] = own, t
        self.count, self.log, self.total = count, log, totals


GROUPED = "chunk long, part int, bucket int, data binary, info binary, context long, lower double, taken double"


def asked_grams(grouped: DataFrame, k: int, uni: Unigrams, orders: list[Order]) -> DataFrame:
    """Each chunk's distinct n-grams of order k, by buckets of their contexts."""

    def send(table: pa.Table) -> pa.Table:
        own = Chunk(table, uni, orders)
        for i in range(2, k):
            own.hear(i)
        info = pa.ipc.open_stream(own.info).read_all()
        rows = own.ask(k, ~np.repeat(info.column("held").to_numpy(zero_copy_only=False), info.column("n").to_numpy()))
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([own.chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], BLOBS.names)

    return grouped.groupBy("chunk").applyInArrow(send, BLOBS)


def count_grams(grouped: DataFrame, k: int, uni: Unigrams, orders: list[Order]) -> DataFrame:
    """Counts of the n-grams of order k, by buckets of their contexts."""
    lower_d = orders[k - 2].d

    def count(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        own = [unsqueezed(r.pop("data")) for r in rows]
        sent = np.concatenate([x[0] for x in own])
        key, context = np.unique(sent, return_inverse=True)
        of = np.searchsorted(key, joined([np.repeat(x[0], x[1]) for x in own], np.uint64))
        word, before = joined([x[6].astype(np.int64)[x[7]] for x in own]), joined([x[9] if k > 2 else x[9][x[7]] for x in own])
        order = np.lexsort((word, of))
        pair = runs(of[order], word[order])
        which = np.empty(len(word), np.int64)
        which[order] = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(word))))
        first = order[pair]
        r = summed(joined([x[8] for x in own])[order], pair)
        of, word, before = of[first], word[first], before[first]
        del order, first
        some = np.zeros(len(key), np.int64)
        some[context] = np.arange(len(sent))
        total, split = joined([x[2] for x in own])[some], joined([x[4] for x in own], bool)[some]
        p = uni.p(before) if k == 2 else kept(lower_d, before) / np.maximum(joined([x[3] for x in own])[some], 1)[of]
        seen = np.flatnonzero(r > 0)
        n = [np.bincount(of[r == i], minlength=len(key)) for i in range(1, MOST + 1)]
        lower = np.bincount(of[seen], p[seen], len(key))
        whole = sum(n) == 0
        replies, asked, at, place = [], [], 0, 0
        for row, x in zip(rows, own, strict=True):
            i, j = r[which[at : at + len(x[7])]], context[place : place + len(x[0])]
            at, place = at + len(i), place + len(j)
            unseen = x[5] | (np.bincount(np.repeat(np.arange(len(j)), x[1]), i == 0, len(j)) > 0)
            needed = j[unseen]
            replies.append(squeezed(i, whole[j], *(v[needed].astype(np.uint32) for v in n), lower[needed]))
            if x[4].any():
                asked.append((row["chunk"], x[0][x[4]].astype(np.int64)))
        followers = np.bincount(of[seen], minlength=len(key))
        has = np.flatnonzero(followers)
        return pa.concat_tables([
            met(REPLIES, len(rows), chunk=[x["chunk"] for x in rows], bucket=[x["bucket"] for x in rows], data=replies),
            met(NUMBERS, 1, counts=[np.bincount(np.minimum(r[seen], MOST + 2), minlength=MOST + 3).tolist()]),
            met(GRAMS, len(has), bucket=[rows[0]["bucket"]] * len(has), context=pa.array(key[has].astype(np.int64)), total=pa.array(total[has]), split=pa.array(split[has]), lower=pa.array(lower[has]), words=lists(word[seen], followers[has]), counts=lists(r[seen], followers[has])),
            met(ASKED, len(asked), chunk=[c for c, _ in asked], words=lists(joined([x for _, x in asked]), np.array([len(x) for _, x in asked], np.int64))),
        ])

    return asked_grams(grouped, k, uni, orders).groupBy("bucket").applyInArrow(count, MET)


def look_up_words(asks: DataFrame, grams: DataFrame, buckets: int) -> DataFrame:
    """Replies to chunks from the stored counts of words."""

    def look(asked: pa.Table, stored: pa.Table) -> pa.Table:
        rows = rows_of(asked)
        kept_rows = rows_of(stored)
        w, c, ids = (joined([np.array(r[x], np.int64) for r in kept_rows]) for x in ("words", "counts", "ids"))
        replies = []
        for r in rows:
            h = unsqueezed(r["data"])[0].astype(np.int64)
            at = np.minimum(np.searchsorted(w, h), max(0, len(w) - 1))
            hit = w[at] == h if len(w) else np.zeros(len(h), bool)
            replies.append(squeezed(np.where(hit, c[at], 0) if len(w) else np.zeros(len(h), np.int64), (np.where(hit, ids[at] // buckets, 0) if len(w) else np.zeros(len(h))).astype(np.uint32)))
        return met(REPLIES, len(rows), chunk=[r["chunk"] for r in rows], bucket=[r["bucket"] for r in rows], data=replies)

    return asks.groupBy("bucket").cogroup(grams.select("bucket", "words", "counts", "ids").groupBy("bucket")).applyInArrow(look, MET)


def look_up_grams(asks: DataFrame, grams: DataFrame) -> DataFrame:
    """Replies to chunks, as ``count_grams`` gives them, from stored contexts with their words and counts."""

    def look(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.sort_by("context").combine_chunks()
        key = stored.column("context").to_numpy().astype(np.uint64)
        lower = stored.column("lower").to_numpy()
        flat = {c: joined([x.flatten().to_numpy() for x in stored.column(c).chunks]) for c in ("words", "counts")}
        size = joined([x.value_lengths().to_numpy() for x in stored.column("words").chunks])
        of = np.repeat(np.arange(len(key)), size)
        n = [np.bincount(of[flat["counts"] == i], minlength=len(key)) for i in range(1, MOST + 1)]
        whole = sum(n) == 0
        pairs = of.astype(np.uint64) << np.uint64(40) | flat["words"].astype(np.uint64)
        replies, asked_split, rows = [], [], rows_of(asked)
        for row in rows:
            x = unsqueezed(row["data"])
            at = np.searchsorted(key, x[0])  # each context that is asked for was seen
            there = np.append(key, np.uint64(0))[at] == x[0]  # of a split one maybe not in this part
            place = np.minimum(at, max(0, len(key) - 1))
            wanted = np.repeat(place, x[1]).astype(np.uint64) << np.uint64(40) | x[6][x[7]]
            i = np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))
            r = np.where((pairs[i] == wanted) & np.repeat(there, x[1]), flat["counts"][i], 0) if len(pairs) else np.zeros(len(wanted), np.int64)
            unseen = x[5] | (np.bincount(np.repeat(np.arange(len(at)), x[1]), r == 0, len(at)) > 0)
            of_context = lambda v: np.where(there, v[place], 0) if len(key) else np.zeros(len(at))  # noqa: B023, E731
            replies.append(squeezed(r.astype(np.int64), of_context(whole).astype(bool), *(of_context(v)[unseen].astype(np.uint32) for v in n), of_context(lower)[unseen].astype(float)))
            if x[4].any():
                asked_split.append((row["chunk"], x[0][x[4]].astype(np.int64)))
        return pa.concat_tables([
            met(REPLIES, len(rows), chunk=[r["chunk"] for r in rows], bucket=[r["bucket"] for r in rows], data=replies),
            met(ASKED, len(asked_split), chunk=[c for c, _ in asked_split], words=lists(joined([x for _, x in asked_split]), np.array([len(x) for _, x in asked_split], np.int64))),
        ])

    return asks.groupBy("bucket").cogroup(grams.select("bucket", "context", "lower", "words", "counts").groupBy("bucket")).applyInArrow(look, MET)


def stored(df: DataFrame, path: str) -> dict[str, DataFrame]:
    """Rows of MET as a table partitioned by kind, and each kind of it."""
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    schema = T.StructType([f for f in MET.fields if f.name != "kind"] + [MET["kind"]])
    table = df.sparkSession.read.schema(schema).parquet(path)
    return {k: table.where(F.col("kind") == k) for k in (REPLIES, NUMBERS, GRAMS, ASKED)}


def numbers(made: dict[str, DataFrame]) -> list[int]:
    """How many n-grams have each count."""
    out = np.zeros(MOST + 3, np.int64)
    for r in made[NUMBERS].select("counts").collect():  # a row for each bucket
        out += np.array(r["counts"])
    return out.tolist()


def weighed(grams: DataFrame, d: tuple[float, ...], least: float) -> DataFrame:
    """Contexts with what discounts take from their counts, the sum of their words' lower probabilities, and their backoff weights."""
    off = F.create_map(*[F.lit(x) for r in range(MOST) for x in (r + 1, (1 - d[r]) * (r + 1))])
    taken = F.aggregate("counts", F.lit(0.0), lambda a, r: a + F.coalesce(F.element_at(off, r.cast("int")), F.lit(0.0)))
    own = grams.select("context", "total", "split", "lower", taken.alias("taken"))
    split = own.where("split").groupBy("context").agg(F.first("total").alias("total"), F.first("split").alias("split"), F.sum("lower").alias("lower"), F.sum("taken").alias("taken"))
    left = F.when(F.col("taken") == 0, 1.0 / (F.col("total") + 1)).otherwise(F.col("taken") / F.col("total"))
    return own.where("NOT split").unionByName(split).withColumn("alpha", left / F.greatest(1 - F.col("lower"), F.lit(least)))


#: Columns of a chunk's rows that only some of them have.
BLANK = {"info": "binary", "context": "long", "lower": "double", "taken": "double"}


def blank(*names: str) -> list:
    return [F.lit(None).cast(BLANK[c]).alias(c) for c in names]


def rows_of_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.lit(0).alias("part"), F.lit(None).cast("int").alias("bucket"), F.col("tokens").alias("data"), "info", *blank("context", "lower", "taken"))


def answers(replies: DataFrame, k: int) -> DataFrame:
    return replies.select("chunk", F.lit(k).alias("part"), "bucket", "data", *blank(*BLANK))


def split_answers(asked: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """Of split contexts what their chunks need."""
    own = asked.select("chunk", F.explode("words").alias("context")).distinct().join(splits, "context")
    return own.select("chunk", F.lit(-k).alias("part"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"), *blank("info"), "context", "lower", "taken")


def evaluated(grouped: DataFrame, uni: Unigrams, orders: list[Order], id_type: T.DataType, id_col: str) -> DataFrame:
    """Each chunk's documents, scored with all replies."""
    per_token = np.log10(uni.tokens + 0.1 * (uni.words + 1))
    from pyspark.sql.pandas.types import to_arrow_type

    out_id = to_arrow_type(id_type)

    def evaluate(table: pa.Table) -> pa.Table:
        own = Chunk(table, uni, orders)
        for k in range(2, len(orders) + 1):
            own.hear(k)
        info = pa.ipc.open_stream(own.info).read_all()
        n = info.column("n").to_numpy()
        of = lambda x: np.add.reduceat(x, np.cumsum(n) - n)
        base = of(np.log10(own.c + 0.1)) - n * per_token
        return pa.table([info.column("id").cast(out_id), info.column("held"), pa.array(n), pa.array(of((own.c > 0).astype(np.int64))), pa.array(np.full(len(n), uni.tokens)), pa.array(base), pa.array(of(own.log))], out_names)

    out_names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in out_names[2:5]], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return grouped.groupBy("chunk").applyInArrow(evaluate, schema).withColumnRenamed("id", id_col)


def score(df: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, order: int = 2) -> DataFrame:
    """Per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Learns n-grams of up to ``order`` words from rows whose crc32 of the id as text isn't 0 modulo ``folds``, and scores all. Words are
    what is between white space (space, tab to return), A-Z lower-cased; each text has an end, which is a token. A null or empty
    text has only its end. Rows with the same id or text count each; null ids count as the empty text. Without training rows
    each word is unknown, with probability 1. An empty table gives no rows. Words are told apart by 55-bit hashes, contexts of
    two words or more by 63-bit ones.
    model_path: where the model's tables are written, by default in the shared folder: ``order=k/kind=grams`` has contexts (for k = 1 none)
    with the words seen after them and their counts, and ``weights/order=k`` contexts' totals and backoff weights; words of k = 1 are hashes,
    whose ids are the words of higher orders. ``score_by`` scores other texts with them. A context of two words or more is a hash of its ids; of one, the id + 3.
    """
    spark = df.sparkSession
    frugal(spark)
    least, path = partitions(spark), model_path or new_path(spark, "katz")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = own.schema.fields[0].dataType
    chunks = written(tokenized(own, folds), "chunks")
    sizes = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "trained", "documents")]).first()
    orders = [Order(max(least, -(-sizes["n_words"] // BUCKET)))]
    made = [stored(count_words(chunks, orders[0].buckets), f"{path}/order=1")]
    of_count = numbers(made[0])
    uni = Unigrams.of(sizes["trained"], sizes["documents"], of_count, sum(of_count))
    orders[0] = Order(orders[0].buckets, uni.d)
    grouped = rows_of_chunks(chunks).unionByName(answers(made[0][REPLIES], 1))
    for k in range(2, order + 1):
        orders.append(Order(max(least, -(-sizes["n_tokens"] // BUCKET))))
        now = stored(count_grams(grouped, k, uni, orders), f"{path}/order={k}")
        orders[-1] = Order(orders[-1].buckets, tuple(discounts(numbers(now))))
        weights = now[GRAMS].transform(weighed, orders[-1].d, uni.unknown if k == 2 else TINY)
        weights.select("context", "total", "alpha").write.option("compression", "zstd").parquet(f"{path}/weights/order={k}")
        weights.where("split").select("context", "lower", "taken").write.parquet(f"{path}/splits/order={k}")
        splits = spark.read.schema("context long, lower double, taken double").parquet(f"{path}/splits/order={k}")
        grouped = grouped.unionByName(answers(now[REPLIES], k)).unionByName(split_answers(now[ASKED], splits, k))
    told = json.dumps({"uni": asdict(uni), "orders": [asdict(o) for o in orders], "bucket": BUCKET})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/model")
    return evaluated(grouped, uni, orders, id_type, id_col)


def score_by(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as ``score`` gives them (held_out is false), of texts that the model at ``model_path`` need not have seen, from its tables alone."""
    spark = df.sparkSession
    frugal(spark)
    told = json.loads(spark.read.text(f"{model_path}/model").first()[0])
    if told["bucket"] != BUCKET:
        raise ValueError("the model was made with another size of buckets")
    uni = Unigrams(**{k: tuple(v) if isinstance(v, list) else v for k, v in told["uni"].items()})
    orders = [Order(o["buckets"], tuple(o["d"])) for o in told["orders"]]
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = written(tokenized(own, 0), "chunks")
    grouped = rows_of_chunks(chunks)
    for k in range(1, len(orders) + 1):
        grams = spark.read.schema(MET).parquet(f"{model_path}/order={k}").where(F.col("kind") == GRAMS)
        asks = asked_words(chunks, orders[0].buckets) if k == 1 else asked_grams(grouped, k, uni, orders)
        found = written(look_up_words(asks, grams, orders[0].buckets) if k == 1 else look_up_grams(asks, grams), "found")
        grouped = grouped.unionByName(answers(found.where(F.col("kind") == REPLIES), k))
        if k > 1:
            splits = spark.read.schema("context long, lower double, taken double").parquet(f"{model_path}/splits/order={k}")
            grouped = grouped.unionByName(split_answers(found.where(F.col("kind") == ASKED), splits, k))
    return evaluated(grouped, uni, orders, own.schema.fields[0].dataType, id_col)
