"""Byte-level BPE by a rank file: encoding by numpy over batches, and decoding.

Pieces come from ``pieces``; distinct ones of a batch are merged side by side, in matrices of equal width: each round
merges in each piece the leftmost pair of the lowest rank. Offsets of documents in the flat ids are those of the Arrow lists.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import PieceEncoder, chunks, classes_by

NO_RANK = np.int32(2**31 - 1)
WIDTHS = (4, 8, 12, 16, 24, 32, 64)


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """The rank of the token that two neighbouring tokens make, by hashing with linear probing in an array."""

    def __init__(self, ranks: dict[bytes, int]):
        a, b, to = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None:
                    a.append(x)
                    b.append(y)
                    to.append(rank)
        pairs = np.array(a, np.uint64) << np.uint64(32) | np.array(b, np.uint64)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.pairs, self.rank = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NO_RANK, np.int32)
        slot, left, to = self.slot(pairs), np.arange(len(pairs)), np.array(to, np.int32)
        while len(left):
            free = self.pairs[slot[left]] == 2**64 - 1
            _, one = np.unique(slot[left[free]], return_index=True)
            put = left[free][one]
            self.pairs[slot[put]], self.rank[slot[put]] = pairs[put], to[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + (self.pairs[slot[left]] != 2**64 - 1)) & ((1 << self.bits) - 1)

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Negative tokens have no pairs."""
        out = np.full(len(a), NO_RANK, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        pairs = a[left].astype(np.uint64) << np.uint64(32) | b[left].astype(np.uint64)
        slot = self.slot(pairs)
        while len(left):
            there = self.pairs[slot]
            hit = there == pairs
            out[left[hit]] = self.rank[slot[hit]]
            on = ~hit & (there != 2**64 - 1)
            left, pairs, slot = left[on], pairs[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Merger:
    """Distinct pieces to ids by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks = ranks

    def long(self, data: bytes) -> list[int]:
        """One piece of any length, by a heap of pairs over a linked list."""
        n = len(data)
        ids, nxt, prev = [int(self.bytes[x]) for x in data], list(range(1, n + 1)), list(range(-1, n - 1))
        parts = [data[i : i + 1] for i in range(n)]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, joined = heapq.heappop(heap)
            if not parts[i] or nxt[i] >= n or parts[i] + parts[nxt[i]] != joined:
                continue
            j = nxt[i]
            parts[i], parts[j], ids[i], nxt[i] = joined, b"", r, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (q := self.ranks.get(both := parts[k] + parts[nxt[k]])) is not None:
                    heapq.heappush(heap, (q, k, both))
        return [ids[i] for i in range(n) if parts[i]]

    def wide(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of tokens, filled up with -1; the same with merged tokens in place, and -1 in between."""
        n, w = tokens.shape
        rank = self.table(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, w - 1)
        nxt, prev = np.tile(np.arange(1, w + 1), (n, 1)), np.tile(np.arange(-1, w - 1), (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            best = rank[rows, at]
            rows, at, best = (x[best != NO_RANK] for x in (rows, at, best))
            after = nxt[rows, at]
            beyond = nxt[rows, after]
            tokens[rows, at], tokens[rows, after], nxt[rows, at] = best, -1, beyond
            inside = beyond < w
            prev[rows[inside], beyond[inside]] = at[inside]
            inner = after < w - 1
            rank[rows[inner], after[inner]] = NO_RANK
            right = np.where(inside, tokens[rows, np.minimum(beyond, w - 1)], -1)
            fits = at < w - 1
            rank[rows[fits], at[fits]] = self.table(best, right)[fits]
            before = prev[rows, at]
            some = before >= 0
            rank[rows[some], before[some]] = self.table(tokens[rows[some], before[some]], best[some])
        return tokens

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.cumsum(size) - size
        counts, low = np.zeros(len(raw), np.int64), 0
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        for w in WIDTHS:
            mine = np.flatnonzero((size > low) & (size <= w))
            low = w
            if len(mine):
                at = np.arange(w)
                tokens = np.where(at < size[mine, None], flat[np.minimum(begin[mine, None] + at, len(flat) - 1)], -1)
                if w > 1:
                    tokens = self.wide(tokens.astype(np.int32))
                kept = tokens >= 0
                counts[mine] = kept.sum(1)
                groups.append((mine, tokens[kept]))
        for i in np.flatnonzero(size > low).tolist():
            ids = np.array(self.long(raw[i]), np.int32)
            counts[i] = len(ids)
            groups.append((np.array([i]), ids))
        out, place = np.zeros(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for mine, ids in groups:
            n = counts[mine]
            out[np.arange(len(ids)) + np.repeat(place[mine] - (np.cumsum(n) - n), n)] = ids
        return out, counts


@cache
def library_classes() -> np.ndarray:
    """The classes that tiktoken goes by, asked with a vocabulary of bytes and of pairs that lie across two characters: within a piece all such
    pairs merge, so that tokens begin at characters only where pieces do."""
    import public_tokenizers
    import tiktoken

    leads, ends = range(0xC2, 0xF5), [10, 35, 49, 97, *range(0x80, 0xC0)]
    ranks = [bytes([b]) for b in range(256)] + [bytes([a, b]) for a in ends for b in leads]
    own = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    size = np.fromiter(map(len, ranks), np.int64, len(ranks))

    def starts(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        n = size[np.array(own.encode_ordinary(text), np.int64)]
        token = np.zeros(len(raw), bool)
        token[np.cumsum(n) - n] = True
        return np.flatnonzero(token[(raw & 0xC0) != 0x80])

    return classes_by(starts)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One of each worker, kept from task to task."""
    return PieceEncoder(Merger(load_ranks(path)), kinds=library_classes())


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, and where each token's begin and how many they are."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode_flat(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and where each text's begin, with the end."""
    blob, begin, size = vocabulary(path)
    n = size[ids]
    ends = np.append(0, np.cumsum(n))
    return blob[np.arange(ends[-1]) + np.repeat(begin[ids] - ends[:-1], n)], ends[offsets]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values from their bytes and where each begins, with the end."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_texts(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Per row: ``id_col``, ``ids`` array<int>, and in ``decoded_col``, if it is named, the bytes that these ids give back.
    A null text is empty; empty texts have no ids. Repeated rows are encoded each; other columns don't count; an empty
    table gives no rows. ranks: a tiktoken rank file that each machine has."""
    decoded = [T.StructField(decoded_col, T.BinaryType())] if decoded_col else []
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(1).to_pylist()):
                ids, offsets = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                back = [binaries(*decode_flat(ids, offsets, ranks))] if decoded_col else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists, *back], schema.names)
                done += len(texts)

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def decode_ids(df: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` binary, the bytes of the ids; null ids give no bytes. Fails on ids that aren't in the file."""
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(kept.index(ids_col))
            n = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            out = binaries(*decode_flat(ids, np.append(0, np.cumsum(n)), ranks))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*kept, out_col])

    return df.select(kept).mapInArrow(run, schema)
