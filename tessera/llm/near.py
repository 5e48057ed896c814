"""Jaccard self-join of documents on word shingles by T-occurrence search, lossless and without a pair for each two copies.

1. Every document's shingles go to buckets by hash. A document can have a partner only if it shares ``threshold`` of its
   shingles with any others; documents that share fewer are done. A chunk sends a shingle once, however many hold it there.
2. Distinct sets of the rest are counted again, by themselves. Each document orders its shingles rarest first; two that link
   must share one among the first of each (prefixes by size). What shares such a shingle, at sizes that allow it, makes blocks.
3. In a block, documents are searched for by the inverted lists of a query's shingles: the short lists are counted (documents
   below T - L occurrences go), the L long ones are bitmaps that are probed for the rest, and those that reach the overlap
   link. Documents that the largest component has by then are no queries. ``divide_skip`` is the same search with a heap and
   binary search; it takes a time for each list, which blocks of near copies don't allow.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, partitions, written
from .components import components, forest
from .exact import MOST_CELLS, flagged, may_have, repeated_cells

#: Shingles of a chunk: what a task holds at once.
CHUNK = 500_000
#: Shingles of the chunks that go to buckets together.
GROUP = 4 * CHUNK
#: Bytes of sets that one block holds; larger ones are searched pair of parts by pair of parts.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose shingles one bucket counts.
BUCKET_BYTES = 16 << 20
#: Blocks of more than one part that are told by broadcast; others, of which each is a small share of the rest, by a join.
LARGE = 10_000
#: Bits of a hash that are compared in the first step.
SHORT_BITS = 48
#: Lists that one of so many sets of a block is in, or more, are bitmaps: a quarter of the sets' bytes at most.
DENSE = 16
CACHED_WORDS = 150_000
DIVIDE = 0.01


class Words:
    """64-bit hashes of words, kept for words seen."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in ascending order and the texts they are of, each once a text."""
    split = [(t or "").encode().lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    w = words([x for s in split for x in s])
    del split
    docs, ends = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)
    at = np.arange(len(w))
    first = at == ends - np.repeat(n, n)
    long = np.repeat(n >= width, n)
    h = np.zeros(len(w), np.uint64)
    padded = np.append(w, np.zeros(width, np.uint64))
    for i in range(width):  # words beyond the end count as none, which makes short texts one shingle of their own
        inside = at + i < ends
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[i : i + len(w)], np.uint64(i + 1))
    used = (long & (at + width <= ends)) | (~long & first)
    h, docs = mixed(h[used]), docs[used]
    order = np.argsort(h, kind="stable")
    h, docs = h[order], docs[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    return h[once], docs[once]


def chunked(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[list, list]]:
    """Ids and texts, by chunks of about ``most`` words of six characters."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for at in range(0, len(batch), 200):  # not a whole batch's texts twice
            few = batch.slice(at, 200)
            for i, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                if texts and (n + len(t or "") > 6 * most or len(texts) >= 60_000):
                    yield ids, texts
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(t)
                n += len(t or "")
    if texts:
        yield ids, texts


def grouped(chunks: Iterator[tuple[np.ndarray, pa.Table]], most: int = GROUP) -> Iterator[list[tuple[np.ndarray, pa.Table]]]:
    """Chunks by groups of ``most`` shingles and 65,000 texts, so that there are fewer rows for each bucket to meet and none is short."""
    parts: list[tuple[np.ndarray, pa.Table]] = []
    for chunk in chunks:
        if parts and (sum(len(p[0]) for p in parts) + len(chunk[0]) > most or sum(len(p[1]) for p in parts) + len(chunk[1]) > 65_000):
            yield parts
            parts = []
        parts.append(chunk)
    if parts:
        yield parts


CODEC = "zstd"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, ascending 64-bit ones as differences, by planes of bytes so that they compress."""
    parts = []
    for x in arrays:
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=np.uint64(0))
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
        packed = pa.compress(raw, CODEC, asbytes=True)
        parts.append(b"%d %d %d %s " % (len(packed), len(raw), len(x), x.dtype.str[1:].encode()) + packed)
    return b"".join(parts)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        fields, pos = [], at
        for _ in range(4):
            end = data.index(b" ", pos)
            fields.append(data[pos:end].decode())
            pos = end + 1
        size, raw, n = map(int, fields[:3])
        flat = np.frombuffer(pa.decompress(data[pos : pos + size], raw, CODEC, asbytes=True) if raw else b"", np.uint8)
        kind = np.dtype("<" + fields[3])
        x = np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x)
        at = pos + size
    return out


BLOBS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("info", T.BinaryType())])


def rows_of(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def blobs(h: np.ndarray, columns: list[np.ndarray], buckets: int, chunk: int, info: bytes | None, bits: int = 64) -> pa.RecordBatch:
    """A chunk's ascending hashes and what goes with them, cut into ranges of the hashes; info goes with the first."""
    bounds = np.concatenate([[0], np.searchsorted(h, np.array([-(-(i << bits) // buckets) for i in range(1, buckets)], np.uint64)), [len(h)]])
    used = np.flatnonzero(np.diff(bounds)).tolist()
    if info is not None and used[:1] != [0]:
        used = [0, *used]
    rows = [(b, squeezed(h[x:y], *(c[x:y] for c in columns))) for b in used for x, y in [bounds[b : b + 2].tolist()]]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([info if r[0] == 0 else None for r in rows], pa.binary())], BLOBS.names
    )


def sets_of(h: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes text by text, ascending in each, and where each text's begin, with the end."""
    order = np.argsort(docs.astype(np.uint16), kind="stable")
    return h[order], np.append(0, np.cumsum(np.bincount(docs, minlength=n_docs)))


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def shared_counts(df: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per row of (id, text): id, n (shingles), key (hash of the set), shared: how many of them others hold too."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema.fields[0].dataType
    id_arrow = to_arrow_type(id_type)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = Words(), TaskContext.get().partitionId()
        for c, parts in enumerate(grouped(sets(batches, words))):
            about = pa.concat_tables([p[1] for p in parts])
            for p, at in zip(parts, np.cumsum([0, *(len(p[1]) for p in parts)]).tolist(), strict=False):
                p[0][:] += np.uint64(at)
            pairs = np.concatenate([p[0] for p in parts])
            parts.clear()
            pairs.sort()
            h, docs = pairs >> np.uint64(64 - SHORT_BITS), pairs.astype(np.uint16)
            del pairs
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            many = ~new
            many[:-1] |= ~new[1:]
            local = np.bincount(docs[many], minlength=len(about))
            h, docs = h[new], np.where(many, np.uint16(65535), docs)[new]
            info = pa.BufferOutputStream()
            table = about.append_column("local", pa.array(local))
            with pa.ipc.new_stream(info, table.schema) as w:
                w.write_table(table)
            yield blobs(h, [docs], buckets, task << 24 | c, info.getvalue().to_pybytes(), SHORT_BITS)

    def sets(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """By chunks: a hash's first bits and, below them, the place of a text that has it; id, n and key of each text."""
        for ids, texts in chunked(batches):
            h, docs = shingles(texts, width, words)
            flat, bounds = sets_of(h, docs, len(texts))
            keys = [key_of(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield h >> np.uint64(64 - SHORT_BITS) << np.uint64(64 - SHORT_BITS) | docs.astype(np.uint64), pa.table({"id": pa.array(ids, id_arrow), "n": np.diff(bounds), "key": pa.array(keys, pa.int64())})

    def meet(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        own = [unsqueezed(r["data"]) for r in rows]
        h = np.concatenate([x[0] for x in own])
        distinct, which, count = np.unique(h, return_inverse=True, return_counts=True)
        del distinct
        common, at, out = count[which] > 1, 0, []
        for r, (x, docs) in zip(rows, own, strict=True):
            hit = docs[common[at : at + len(x)]]
            at += len(x)
            place, n = np.unique(hit[hit < 65535], return_counts=True)
            out.append((r["chunk"], squeezed(place, n.astype(np.uint32)), r["info"]))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["chunk", "data", "info"])

    def gather(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        info = pa.ipc.open_stream(next(r["info"] for r in rows if r["info"] is not None)).read_all()
        shared = info.column("local").to_numpy().copy()
        for r in rows:
            place, n = unsqueezed(r["data"])
            shared[place] += n.astype(np.int64)
        return pa.table([info.column("id"), info.column("n"), info.column("key"), pa.array(shared)], ["id", "n", "key", "shared"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("shared", T.LongType())])
    met = df.mapInArrow(send, BLOBS).groupBy("bucket").applyInArrow(meet, "chunk long, data binary, info binary")
    return met.groupBy("chunk").applyInArrow(gather, schema)


def digest(column: str) -> Column:
    """What a filter is asked about an id of any type; null is as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256)).alias("digest")


def candidate_sets(df: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """key, n and hashes of the sets of rows (id, text) whose ids the filter ``wanted`` may have, each once."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(may_have(shared.value, batch.column(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for _, texts in chunked(picked(batches)):
            flat, bounds = sets_of(*shingles(texts, width, words), len(texts))
            out = []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if x < y and (key := key_of(flat[x:y])) not in seen:
                    if len(seen) > 1_000_000:  # only saves sending a set twice
                        seen.clear()
                    seen.add(key)
                    out.append((key, y - x, flat[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["key", "n", "hashes"])

    return df.select("id", "text", digest("id")).mapInArrow(run, "key long, n long, hashes binary").dropDuplicates(["key"])


def prefixes(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first shingles must hold one that a partner shares among its own: a partner of any size; one of the same size or more."""
    return n - -(-num * n // den) + 1, n - -(-2 * num * n // (num + den)) + 1


def block_links(sets: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Links (a, b) of keys whose components hold all partners: sets that share a shingle of their prefixes, rarest first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, c = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, n, data = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(keys):
                to, total = at, 0
                while to < len(keys) and (to == at or total + n[to] <= CHUNK) and to - at < 65_000:
                    total += n[to]
                    to += 1
                h = np.frombuffer(b"".join(data[at:to]), np.uint64)
                docs = np.repeat(np.arange(to - at), n[at:to]).astype(np.uint16)
                order = np.argsort(h, kind="stable")
                info = squeezed(np.array(keys[at:to], np.int64), np.array(n[at:to], np.int64))
                yield blobs(h[order], [docs[order]], buckets, task << 24 | c, info)
                at, c = to, c + 1

    def count(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        own = [unsqueezed(r["data"]) for r in rows]
        _, which, n = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True, return_counts=True)
        n, at, out = np.minimum(n, 65535).astype(np.uint16)[which], 0, []
        for r, (h, docs) in zip(rows, own, strict=True):
            common = n[at : at + len(h)] > 1
            out.append((r["chunk"], squeezed(h[common], docs[common], n[at : at + len(h)][common]), r["info"]))
            at += len(h)
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["chunk", "data", "info"])

    def first(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        keys, size = unsqueezed(next(r["info"] for r in rows if r["info"] is not None))
        own = [unsqueezed(r["data"]) for r in rows]
        h, docs, n = (np.concatenate([x[i] for x in own]) for i in range(3))
        order = np.lexsort((h, n, docs))
        h, docs = h[order], docs[order].astype(np.int64)
        many = np.bincount(docs, minlength=len(keys))
        at = np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many) + (size - many)[docs]  # after those that no other has
        probe, index = prefixes(size, num, den)
        used = at < probe[docs]
        h, docs, at = h[used], docs[used], at[used]
        order = np.argsort(h, kind="stable")
        h, docs, at = h[order], docs[order], at[order]
        batch = blobs(h, [keys[docs], size[docs].astype(np.int32), (at < index[docs]).astype(np.uint8)], buckets, rows[0]["chunk"], None)
        return pa.Table.from_batches([batch])

    def join(table: pa.Table) -> pa.Table:
        own = [unsqueezed(x.as_py()) for x in table.column("data")]
        h, key, n, index = (np.concatenate([x[i] for x in own]) for i in range(4))
        n = n.astype(np.int64)
        order = np.lexsort((key, n, h))
        h, key, n, index = h[order], key[order], n[order], index[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (den * n[:-1] < num * n[1:])  # a gap in sizes that no link spans
        run = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        some = np.add.reduceat(index.astype(np.int64), start)[run] > 0
        a, b = key[start][run][some], key[some]
        a, b = forest(a, b) if len(a) else (a, b)
        return pa.table({"a": a, "b": b})

    counted = sets.select("key", "n", "hashes").mapInArrow(send, BLOBS).groupBy("bucket").applyInArrow(count, "chunk long, data binary, info binary")
    return counted.groupBy("chunk").applyInArrow(first, BLOBS).groupBy("bucket").applyInArrow(join, "a long, b long")


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Values that ``least`` of the ascending lists have or more, with their number. Lists that can't matter skip ahead."""
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield value, len(popped)
            for i in popped:
                at[i] += 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            for i in popped:
                at[i] = bisect_left(lists[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def divide_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """As ``merge_skip``: short lists are merged, for ``least`` less the number of long ones; in these each value is probed."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return
    n_long = min(least - 1, int(least / (DIVIDE * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for value, count in merge_skip(short, least - n_long):
        for k, x in enumerate(long):
            if count + n_long - k < least:
                break
            i = bisect_left(x, value)
            count += i < len(x) and x[i] == value
        if count >= least:
            yield value, count


def bitmaps(doc: np.ndarray, column: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words of 64 columns by places: the columns that each of ``n`` places has; ``doc`` is ascending."""
    words = -(-width // 64)
    out = np.zeros((n, 8 * words), np.uint8)
    step = max(1, (4 << 20) // max(1, 64 * words))
    for at in range(0, n, step):
        low, high = np.searchsorted(doc, [at, at + step])
        flat = np.zeros((min(step, n - at), 64 * words), bool)
        flat[doc[low:high] - at, column[low:high]] = True
        out[at : at + step] = np.packbits(flat, axis=1)
    return np.ascontiguousarray(out.view(np.uint64).T)


def search(sets: list[np.ndarray], num: int, den: int) -> tuple[list[int], list[int]]:
    """Links between places in ``sets`` that give the components of all links; sets are ordered by size.

    Lists that one of DENSE sets or more are in are the long ones: all queries share them as bitmaps. A query counts its short
    lists, and probes the long ones of what has T less the number of long ones or more. All sets are queries but those that
    the largest component has by then: what they link to outside of it is a query itself.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc, held = np.repeat(np.arange(n, dtype=np.int32), size), df[code]
    central = np.add.reduceat(held, np.cumsum(size) - size) / size
    long = df >= max(2, n / DENSE)
    dense = long[code]
    bits = bitmaps(doc[dense], (np.cumsum(long) - 1)[code[dense]], n, int(long.sum()))
    n_long = np.bincount(doc[dense], minlength=n)
    sparse = (held > 1) & ~dense
    code, doc = code[sparse].astype(np.int32), doc[sparse]
    n_short = np.bincount(doc, minlength=n)
    ends = np.cumsum(n_short)
    listed, df = doc[np.argsort(code, kind="stable")], np.where(long | (df < 2), 0, df)
    start = np.cumsum(df) - df
    del held, dense, sparse, doc

    def partners(x: int) -> np.ndarray:
        least = -(-num * size[x] // den)
        low, high = np.searchsorted(size, least), np.searchsorted(size, den * size[x] // num, "right")
        if n_long[x] + n_short[x] < least:
            return np.zeros(0, np.int64)
        if n_short[x]:
            own = code[ends[x] - n_short[x] : ends[x]]
            at = np.repeat(start[own] + df[own] - np.cumsum(df[own]), df[own]) + np.arange(df[own].sum())
            count = np.bincount(listed[at], minlength=n)[low:high]
        else:
            count = np.zeros(high - low, np.int64)
        needed = -(-num * (size[x] + size[low:high]) // (num + den))
        may = np.flatnonzero(count + np.minimum(n_long[x], n_long[low:high]) >= needed)
        words = np.flatnonzero(bits[:, x])
        probed = bits[words, low:high] if len(may) == high - low else bits[np.ix_(words, low + may)]
        overlap = count[may] + np.bitwise_count(probed & bits[words, x][:, None]).sum(0, dtype=np.int64)
        return low + may[overlap >= needed[may]]

    label, asked, main = np.arange(n), np.zeros(n, bool), 0
    a: list[int] = []
    b: list[int] = []
    while len(left := np.flatnonzero(~asked & (label != main))) and not (len(left) == 1 and asked.sum() == n - 1):  # the last one's links are known
        for x in left[np.argsort(-central[left], kind="stable")].tolist():
            if label[x] == main:
                continue
            asked[x] = True
            y = partners(x)
            others, first = np.unique(label[y], return_index=True)
            apart = others != label[x]
            if apart.any():
                a += [x] * int(apart.sum())
                b += y[first[apart]].tolist()
                label[np.isin(label, others)] = label[x]
                main = np.bincount(label).argmax()
    return a, b


def search_blocks(sets: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of keys, found block by block."""
    known = sets.join(roots.select(F.col("node").alias("key"), "root"), "key")
    parts = roots.join(sets.select(F.col("key").alias("node"), "n"), "node").groupBy("root").agg(F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    others = F.expr("transform(sequence(0, parts - 1), j -> struct(least(j, part) AS low, greatest(j, part) AS high))")
    parts = written(parts, "parts")
    large = parts.where("parts > 1").orderBy(F.desc("parts"), "root").limit(LARGE)
    dealt = joined(known, parts, "root", large).withColumn("part", part).withColumn("pair", F.explode(others)).select("root", "pair.low", "pair.high", "key", "n", "hashes")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("key", "ascending")])
        keys = table.column("key").to_numpy()
        a, b = search([np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")], num, den)
        return pa.table({"a": pa.array(keys[a] if a else [], pa.int64()), "b": pa.array(keys[b] if b else [], pa.int64())})

    return dealt.groupBy("root", "low", "high").applyInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", filter_cells: int = MOST_CELLS) -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id: the smallest id that links reach, itself included.

    Words are what is between white space (space, tab to return), A-Z lower-cased; a text's set are its distinct shingles
    of ``width`` words, or its whole sequence if it has fewer. Two sets link when den * intersection >= num * union. A null
    or empty text has no shingles and links with nothing, not even another one. Rows that repeat are linked as copies; of
    null ids the component's is that of other rows, or null. An empty table gives no rows. Sets and shingles are told apart
    by 64-bit hashes. Only ``id_col`` and ``text_col`` are read.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(df.sparkSession), -(-size // BUCKET_BYTES))  # so that a bucket doesn't grow with the table
    slim = written(shared_counts(own, width, buckets), "shared")
    wanted = slim.where((F.col("n") > 0) & (F.col("shared") * den >= F.col("n") * num)).select(digest("id"))
    cells = min(filter_cells, 1 << max(16, (16 * wanted.count()).bit_length()))
    bits = repeated_cells(wanted, cells, 1)
    sets = written(candidate_sets(own, width, bits), "sets")
    roots = components(block_links(sets, num, den, buckets))
    found = components(search_blocks(sets, roots, num, den))
    found, many = found.withColumnRenamed("node", "key"), max(1000, slim.count() * 1e-3)
    hot = slim.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > many).join(found, "key").select("key", "root")  # fewer than 1000
    grouped = joined(slim, found, "key", hot, "left").withColumn("root", F.coalesce("root", "key"))
    grouped = written(grouped.select("id", "n", "root"), "grouped")
    least = grouped.where("n > 0").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    least = written(least, "least")
    out = joined(grouped, least.select("root", "least"), "root", least.where(F.col("size") > many).select("root", "least"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_copies(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", filter_cells: int = MOST_CELLS) -> DataFrame:
    """One row of each component, with all columns: that of the smallest id. Rules as in ``jaccard_components``; ids name documents,
    so that rows with the same id stay or go together, and rows with null ids go if another row is in their component. Only
    rows that a Bloom filter of the ids that go may have are shuffled."""
    found = written(jaccard_components(df, width, num, den, id_col, text_col, filter_cells), "components")
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("gone")).distinct()
    cells = min(filter_cells, 1 << max(16, (16 * gone.count()).bit_length()))
    bits = repeated_cells(gone.select(digest("gone")), cells, 1)
    names = {f"c{i}": c for i, c in enumerate(df.columns)}
    rows = flagged(df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()]).withColumn("digest", digest(f"c{df.columns.index(id_col)}")), bits)
    own = F.col(f"c{df.columns.index(id_col)}")
    stay = rows.where("NOT may_repeat").unionByName(rows.where("may_repeat").join(gone, own.eqNullSafe(F.col("gone")), "left_anti"))
    return stay.select(*names).withColumnsRenamed(names)
