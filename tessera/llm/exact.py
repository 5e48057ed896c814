"""Exact dedup by two passes over a Bloom filter with counts: only rows whose text may repeat are shuffled.

The first pass writes each row's digest and sends the cells that digests hash to, by blocks of the filter, so that a task holds its
own slice of it and counts which cells were hit twice. A text can repeat only if all its cells were, so the other rows pass
straight through; the rest are grouped by digest. The filter has 16 cells a row, and ``most_cells`` at most (2^30, 128 MB of bits, as it is
broadcast): beyond some 100 million rows more and more digests are shuffled, never texts, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, with_text, written

HASHES = 4
#: Blocks of a filter, at most, and the least cells of one.
BLOCKS, BLOCK = 1024, 1 << 16
MOST_CELLS = 1 << 30
#: Groups that hold more than this share of the rows in question are joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1e-3


def digests(df: DataFrame, id_col: str, text_col: str, kept: list[str] | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """id, n_code_points and digest (SHA-256 of the text without white space), after the columns ``kept``; with a filter's bits,
    may_repeat as well, in the same pass."""
    kept = kept or [id_col]
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    id_at = kept.index(id_col)
    rows, at = with_text(df, kept, text_col)
    schema = T.StructType([*fields, T.StructField("id", df.schema[id_col].dataType), T.StructField("n_code_points", T.LongType()), T.StructField("digest", T.BinaryType())])
    white, shared = WHITE.encode(), None
    if bits is not None:
        schema.add("may_repeat", T.BooleanType())
        shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            data = [hashlib.sha256(x.translate(None, white)).digest() for x in texts.cast(pa.binary()).to_pylist()]
            digest = pa.array(data, pa.binary())
            may = [may_have(shared.value, digest)] if shared else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], batch.column(id_at), pc.utf8_length(texts).cast(pa.int64()), digest, *may], schema.names)

    return rows.mapInArrow(run, schema)


def cells_of(column: pa.Array, cells: int) -> np.ndarray:
    """The cells of each digest, HASHES to a row."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)
    return (words[:, :HASHES] & np.uint64(cells - 1)).astype(np.int64)


def may_have(bits: np.ndarray, column: pa.Array) -> pa.Array:
    """Whether all cells of each digest are set."""
    hit = cells_of(column, 8 * len(bits))
    return pa.array(((bits[hit >> 3] >> (7 - (hit & 7)).astype(np.uint8)) & 1).all(1))


def repeated_cells(slim: DataFrame, cells: int, least: int = 2) -> np.ndarray:
    """Bits of the cells that ``least`` (1 or 2) rows or more hit. What comes to the driver has ``cells`` bits, whatever the number of rows."""

    block = min(cells, max(BLOCK, cells // BLOCKS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.sort(cells_of(batch.column(0), cells).ravel())
            start = np.flatnonzero(np.diff(hit // block, prepend=-1))
            parts = np.split((hit % block).astype(np.uint32), start[1:])
            yield pa.RecordBatch.from_arrays([pa.array(hit[start] // block, pa.int32()), pa.array([x.tobytes() for x in parts] if len(start) else [], pa.binary())], ["block", "hits"])

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros(block, np.uint8)
        for x in table.column("hits"):
            hit, n = np.unique(np.frombuffer(x.as_buffer(), np.uint32), return_counts=True)
            counts[hit] = np.minimum(counts[hit] + np.minimum(n, 2), 2)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(counts >= least).tobytes()], pa.binary())})

    bits = np.zeros(cells // 8, np.uint8)
    for row in slim.select("digest").mapInArrow(send, "block int, hits binary").groupBy("block").applyInArrow(total, "block int, bits binary").collect():
        own = np.frombuffer(row["bits"], np.uint8)
        bits[row["block"] * block // 8 :][: len(own)] = own
    return bits


def flagged(df: DataFrame, bits: np.ndarray) -> DataFrame:
    """Adds may_repeat, by the column digest."""
    shared, names = df.sparkSession.sparkContext.broadcast(bits), df.columns
    at = names.index("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, may_have(shared.value, batch.column(at))], [*names, "may_repeat"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("may_repeat", T.BooleanType())]))


def plan(df: DataFrame, id_col: str, text_col: str, most_cells: int) -> tuple[DataFrame, np.ndarray, DataFrame, DataFrame]:
    """Digests of all rows with may_repeat; the filter's bits; groups of the rows that may repeat; the hot ones of these."""
    slim = written(digests(df, id_col, text_col).drop("c0").withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = slim.count()
    bits = repeated_cells(slim, min(most_cells, 1 << max(16, (16 * rows).bit_length())))
    slim = flagged(slim, bits)
    # the most code points, then the smallest id (null ids last), then the first row
    best = F.min(F.struct(-F.col("n_code_points"), F.col("id").isNull(), F.col("id"), F.col("row")))
    groups = slim.where("may_repeat").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    return slim, bits, groups, groups.where(F.col("group_size") > max(1000, rows * HOT_SHARE))


def in_groups(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds keep_id, keep_row and group_size by digest: hot groups come by broadcast, and only the other rows are shuffled."""
    hot = hot.select("digest", *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "group_size")])
    seen = rows.join(F.broadcast(hot), "digest", "left")
    known = seen.where("hot_group_size IS NOT NULL").withColumnsRenamed({f"hot_{c}": c for c in ("keep_id", "keep_row", "group_size")})
    rest = seen.where("hot_group_size IS NULL").drop("hot_keep_id", "hot_keep_row", "hot_group_size")
    return known.unionByName(rest.join(groups, "digest"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_cells: int = MOST_CELLS) -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without white space (space, tab to return); null is empty, and empty texts are equal. Of
    equal texts the row with the most code points stays, then the smallest id (null ids last); of rows that are alike in
    both, one. Only ``id_col`` and ``text_col`` are read; an empty table gives no rows.
    """
    slim, _, groups, hot = plan(df, id_col, text_col, most_cells)
    alone = slim.where("NOT may_repeat").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    grouped = in_groups(slim.where("may_repeat"), groups, hot).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    return alone.unionByName(grouped).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows that stay, with all their columns; rules as in ``exact_groups``. Rows that can't repeat aren't shuffled."""
    _, bits, groups, hot = plan(df, id_col, text_col, most_cells)
    rows = digests(df, id_col, text_col, df.columns, bits)
    alone, repeated = rows.where("NOT may_repeat"), in_groups(rows.where("may_repeat"), groups, hot)
    stays = repeated.where(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("least", -F.col("n_code_points"))
    stays = stays.groupBy("digest").agg(F.min_by(F.struct(*[f"c{i}" for i in range(len(df.columns))]), "least").alias("x"))
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    return alone.select(names).unionByName(stays.select("x.*").select(names))
