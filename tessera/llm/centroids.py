"""Exact k-means on integer vectors with Hamerly's bounds.

Each vector keeps the number of its centroid, an upper bound of the distance to it and one lower bound of the distances to all
others. When centroids move, the upper bound grows by its centroid's drift and the lower one shrinks by the largest drift of
another; only where they cross, or half the distance to the next centroid doesn't part them, is the upper bound made exact, and only
what is ambiguous even then is compared with all centroids, in integers, so that ties go to the smaller number. Bounds are doubles
with a margin for rounding: they skip work, and never decide between near distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PATHS, drop_path, written

#: Components beyond this have distances that don't fit in 64 bits for certain.
LARGEST = 1 << 27
#: Vectors of a step within a batch.
ROWS = 8192
#: A bound is widened by this share of itself, far above what a few roundings make.
MARGIN = 1e-9
STATE = "id long, q array<long>, cluster int, was int, upper double, lower double, full boolean"


def exact(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids."""
    out = np.empty((len(q), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = q - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass(frozen=True)
class Move:
    """Centroids of a round, how far at most each has come from the round before, and half the least distance from each to another."""

    centroids: np.ndarray
    drift: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, before: np.ndarray, after: np.ndarray) -> Move:
        d = after - before
        apart = exact(after, after).astype(float)
        np.fill_diagonal(apart, np.inf)
        nearest = apart.min(1) if len(after) > 1 else np.full(len(after), np.inf)
        return cls(after, np.sqrt((d * d).sum(1).astype(float)) * (1 + MARGIN), np.sqrt(nearest) / 2 * (1 - MARGIN))

    def other_drift(self) -> np.ndarray:
        """For each centroid the largest drift of another."""
        if len(self.drift) < 2:
            return np.zeros(len(self.drift))
        order = np.argsort(self.drift)
        out = np.full(len(self.drift), self.drift[order[-1]])
        out[order[-1]] = self.drift[order[-2]]
        return out


def scanned(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full scans: the nearest centroid (the first of equals), and bounds of the distances to it and to the next one."""
    d = exact(q, centroids)
    best = d.argmin(1)
    near = d[np.arange(len(q)), best]
    d[np.arange(len(q)), best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float)) * (1 - MARGIN) if len(centroids) > 1 else np.full(len(q), np.inf)
    return best, np.sqrt(near.astype(float)) * (1 + MARGIN), lower


def assigned(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after a move, and which vectors had a full scan."""
    upper = (upper + move.drift[cluster]) * (1 + MARGIN)
    lower = (lower - move.other_drift()[cluster]) * (1 - MARGIN)
    apart = np.maximum(lower, move.half[cluster])
    close = np.flatnonzero(upper >= apart)
    if len(close):
        d = q[close] - move.centroids[cluster[close]]
        upper[close] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float)) * (1 + MARGIN)
    open_ = close[upper[close] >= apart[close]]
    cluster, full = cluster.copy(), np.zeros(len(q), bool)
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = scanned(q[open_], move.centroids)
        full[open_] = True
    return cluster, upper, lower, full


def column(batch: pa.RecordBatch, name: str, n: int, width: int) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False).reshape(n, width)


def integer_vectors(df: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and q: floor(scale x) of vectors with ``width`` components, none null or not finite."""
    own = df.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(F.size("v") == width)
    fine = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    q = F.transform("v", lambda x: F.floor(x * scale))
    small = F.forall(q, lambda x: x.between(-LARGEST, LARGEST))
    return fine.select(F.col("id"), F.when(small, q).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<bigint>")).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id; null ids come last, and of equal ids the smaller vector first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(key), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def stepped(state: DataFrame, move: Move, width: int, first: bool) -> DataFrame:
    """One round. first: there are no clusters and bounds yet."""
    shared = state.sparkSession.sparkContext.broadcast(move)
    names = T._parse_datatype_string(STATE).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                n = batch.num_rows
                q = column(batch, "q", n, width)
                if first:
                    was = np.full(n, -1)
                    cluster, upper, lower = scanned(q, own.centroids)
                    full = np.ones(n, bool)
                else:
                    was = batch.column("cluster").to_numpy()
                    cluster, upper, lower, full = assigned(q, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), own)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(full)], names)

    schema = T.StructType([T.StructField("id", state.schema["id"].dataType), *T._parse_datatype_string(STATE).fields[1:]])
    return state.mapInArrow(run, schema)


def moved_sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What changes in counts and sums of clusters: only vectors that have changed cluster are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if n := batch.num_rows:
                q = column(batch, "q", n, width)
                for sign, c in ((1, batch.column("cluster").to_numpy()), (-1, batch.column("was").to_numpy())):
                    for j in range(k):
                        own = c == j
                        count[j] += sign * own.sum()
                        total[j] += sign * q[own].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.where("cluster <> was").select("q", "cluster", "was").mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect()  # k rows
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in rows:
        count[r["cluster"]], total[r["cluster"]] = r["n"], r["total"]
    return count, total


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) of each vector after ``rounds`` rounds, and the centroids.

    Vectors are integers, floor(scale x); those of another width, or with null or non-finite components, are left out. Centroids start as the
    ``k`` vectors (or as many as there are) with the smallest sha256 of seed and id, and become the floor of each component's mean; those without
    vectors stay. Equal distances go to the smaller number. Rows with one id count each; null ids are kept, and start no
    centroid before others. An empty table gives no rows; other columns aren't read. A round's state is written, and the one before it is deleted
    then: a lost executor costs a task, and disk holds two of them at most.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, width, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    many = len(centroids)
    state = written(stepped(vectors, Move.between(centroids, centroids), width, True), "clusters")
    path = PATHS[-1]
    count, total = np.zeros(many, np.int64), np.zeros((many, width), np.int64)
    for _ in range(rounds):
        n, t = moved_sums(state, many, width)
        count, total = count + n, total + t
        after = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        move, before, centroids = Move.between(centroids, after), path, after
        state = written(stepped(state, move, width, False), "clusters")
        path = PATHS[-1]
        drop_path(spark, before)
    return distances(state, centroids, width), centroids


def distances(state: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """id, cluster and distance of vectors with their clusters."""
    shared = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            d = column(batch, "q", batch.num_rows, width) - shared.value[cluster]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", state.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return state.select("id", "q", "cluster").mapInArrow(run, schema)
