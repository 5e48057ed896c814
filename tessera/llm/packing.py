"""Harmonic packing of documents into sequences of a fixed capacity.

Class k holds pieces of capacity // k ids, and each of its bins takes k of them, whatever the documents. Documents are cut
into pieces of such lengths only: whole sequences, then the cheapest sum of class lengths for the rest, by padding and cuts.
A piece's bin and offset follow from its rank in its class alone, so that workers fill bins independently: each counts its
pieces by class, and prefix sums over the counts of workers give the ranks. What doesn't fill a bin of its class (fewer than
k pieces) is laid end to end in further sequences and cut at their borders; all but the last of these are full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .library import text_encoder
from .pieces import chunks

#: What one more cut costs, in ids of padding.
CUT_COST = 6.0
#: Rows of (worker, class) up to which they are broadcast: about 40 MB.
BROADCAST_ROWS = 1_000_000


@lru_cache(8)
def cuts(capacity: int) -> list[tuple[int, ...]]:
    """For each length below capacity, its pieces' lengths, longest first."""
    lengths = sorted({capacity // k for k in range(2, capacity + 1)})
    cost, last = [0.0] + [0.0] * (capacity - 1), [0] * capacity
    for n in range(1, capacity):
        cost[n], last[n] = min((cost[n - x] + (capacity - capacity // x * x) / (capacity // x) + CUT_COST, -x) for x in lengths if x <= n)
    out: list[tuple[int, ...]] = [()]
    for n in range(1, capacity):
        out.append(tuple(sorted((*out[n + last[n]], -last[n]), reverse=True)))
    return out


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Adds end_id to each document."""
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def pieces_of(df: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their ids, the worker (task) that cut them and their rank among its pieces of the same length."""
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "task", "rank")] + [T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest, task = text_encoder(tokenizer), cuts(capacity), TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(1).to_pylist()):
                ids, offsets = with_end(*own.encode(texts), end_id)
                tokens = np.diff(offsets)
                parts = [(capacity,) * (n // capacity) + rest[n % capacity] for n in tokens.tolist()]
                many = np.fromiter(map(len, parts), np.int64, len(parts))
                length = np.fromiter((x for p in parts for x in p), np.int64, int(many.sum()))
                ends = np.cumsum(length)
                doc = np.repeat(np.arange(len(texts)), many)
                order = np.argsort(length, kind="stable")
                size, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first - before[size], count)
                before[size] += count
                data = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, ends * 4)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)).take(pa.array(doc))]
                    + [pa.array(x) for x in (ends - length - offsets[doc], length, tokens[doc], np.full(len(length), task), rank)]
                    + [data.cast(pa.binary())],
                    schema.names,
                )
                done += len(texts)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``id_col``, start (its document's ids before it), length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit). Each id of each document is in one piece; pieces of a sequence follow each other from
    offset 0 without a gap. Only ``id_col`` and ``text_col`` are read. A null or empty text has only its end id (no piece
    where end_id is None); long texts fill many sequences; repeated rows are packed each; an empty table has no pieces.
    tokenizer: a file of the tokenizers library that each machine has.
    """
    pieces = written(pieces_of(df, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "counts")
    # one row for each length that occurs, fewer than 2 * sqrt(capacity)
    each = F.floor(F.lit(capacity) / F.col("length"))
    shorter = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("each", each).withColumn("bins", F.floor(F.col("n") / F.col("each")))
    classes = classes.withColumn("left", F.col("n") - F.col("bins") * F.col("each"))
    classes = classes.select(
        "length", "each", "bins", F.coalesce(F.sum("bins").over(shorter), F.lit(0)).alias("bins_before"),
        F.coalesce(F.sum(F.col("left") * F.col("length")).over(shorter), F.lit(0)).alias("left_before"),
    )
    whole = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("all_bins"))
    known = counts.drop("n").join(F.broadcast(classes), "length").crossJoin(F.broadcast(whole))
    known = F.broadcast(known) if counts.count() <= BROADCAST_ROWS else known
    placed = pieces.join(known, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    bin_no = F.floor(F.col("rank") / F.col("each"))
    at = F.col("left_before") + (F.col("rank") - F.col("bins") * F.col("each")) * F.col("length")
    part = lambda seq, off, start, n: F.struct(seq.alias("sequence_id"), off.cast("long").alias("offset"), start.alias("start"), n.cast("long").alias("length"))
    seq, off, size, start = F.col("all_bins") + F.floor(at / capacity), at % capacity, F.col("length"), F.col("start")
    room = F.lit(capacity) - off
    parts = (
        F.when(bin_no < F.col("bins"), F.array(part(F.col("bins_before") + bin_no, (F.col("rank") % F.col("each")) * size, start, size)))
        .when(off + size <= capacity, F.array(part(seq, off, start, size)))
        .otherwise(F.array(part(seq, off, start, room), part(seq + 1, F.lit(0), start + room, size - room)))
    )
    out = placed.select("_id", "doc_tokens", "ids", F.col("start").alias("from"), F.explode(parts).alias("p"))
    ids = F.expr("substring(ids, CAST((p.start - `from`) * 4 + 1 AS INT), CAST(p.length * 4 AS INT))")
    return out.select(F.col("_id").alias(id_col), "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", ids.alias("ids"))
