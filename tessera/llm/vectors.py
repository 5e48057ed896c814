"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own; a pair of codewords is a cell of the product grid.
Every distinct vector is indexed in its cell and is a query: multi-sequence traversal visits cells in the order of the summed
squared distances of both halves to their codewords, until they are farther than the nearest by a slack that on a sample
has the target recall. Candidates are verified by their cosines in double precision. Codebooks and slack come from a bounded
sample; all rows are indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, written
from .components import components, forest

#: Distinct vectors that codebooks and slack are fitted on, at most.
SAMPLE = 20_000
#: Queries and indexed vectors of a cell that one task compares at once.
SIDE = 4096


@dataclass(frozen=True)
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their codewords."""
        h = self.left.shape[1]
        return tuple(np.maximum(0, (y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1)) for y, c in ((x[:, :h], self.left), (x[:, h:], self.right)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells that each vector visits, nearest first."""
        out = []
        for a, b in zip(*self.distances(x), strict=True):
            u, v = a.argsort(), b.argsort()
            nearest = a[u[0]] + b[v[0]]
            heap, seen, found = [(nearest, 0, 0)], {(0, 0)}, []
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > nearest + self.slack:
                    break
                found.append(int(u[i]) * len(self.right) + int(v[j]))
                for p in ((i + 1, j), (i, j + 1)):
                    if p[0] < len(u) and p[1] < len(v) and p not in seen:
                        seen.add(p)
                        heapq.heappush(heap, (a[u[p[0]]] + b[v[p[1]]], *p))
            out.append(found)
        return out


def codebook(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from random rows; codewords without rows stay."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray, cosine: float, k: int, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks, and the least slack that finds a link from one of its ends with the wanted recall: of links in the sample,
    and of its vectors with others made at just the limit, in random directions."""
    rng = np.random.default_rng(seed)
    h = x.shape[1] // 2
    own = MultiIndex(codebook(x[:, :h], k, 12, rng), codebook(x[:, h:], k, 12, rng), 0.0)

    def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = own.distances(p), own.distances(q)
        at = np.arange(len(p))
        one = a[at, c.argmin(1)] + b[at, d.argmin(1)] - a.min(1) - b.min(1)
        other = c[at, a.argmin(1)] + d[at, b.argmin(1)] - c.min(1) - d.min(1)
        return np.minimum(one, other)

    base = x[:4096]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1)[:, None] * base
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    slacks = [np.quantile(excess(base, cosine * base + np.sqrt(max(0, 1 - cosine**2)) * away), recall)]
    found = []
    for i in range(0, len(x), 1024):
        p, q = np.nonzero(x[i : i + 1024] @ x.T >= cosine)
        p, q = p[p + i < q] + i, q[p + i < q]
        if len(p) > 4096:
            some = rng.choice(len(p), 4096, replace=False)
            p, q = p[some], q[some]
        found.append(excess(x[p], x[q]))
    if sum(map(len, found)):
        slacks.append(np.quantile(np.concatenate(found), recall))
    return MultiIndex(own.left, own.right, float(max(slacks)) * 1.02 + 1e-9)


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (null if it can't link; floats stay floats, which are sent at half the size) of all rows."""
    own = df.schema[vec_col].dataType
    v = F.col(vec_col) if own.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("vec"))


def near_duplicates(df: DataFrame, cosine: float = 0.95, codewords: int | None = None, recall: float = 0.998, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Per row: ``id_col``, n_links (other rows that link with it), component_id (smallest id that links reach), kept.

    codewords: of each half; by default about a quarter of the square root of the number of distinct vectors, 8 to 1024.
    Rows link if the cosine of their vectors, in double precision, is at least ``cosine``. Vectors that are null, zero, empty
    or hold null or non-finite values link with nothing, and so do vectors of different lengths. Equal vectors are indexed
    once and count with their number. Rows with the same id count each. An empty table gives no rows; other columns aren't
    read. A null id has no place in a component: its row has its links counted and the smallest other id.
    """
    spark = df.sparkSession
    rows = distinct_vectors(df, id_col, vec_col)
    groups = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.select(F.monotonically_increasing_id().alias("num"), "rep", "copies", "vec", F.size("vec").alias("dim")), "vectors")
    dims = [r["dim"] for r in groups.select("dim").distinct().collect()]
    found = spark.createDataFrame([], "id long, n long, a long, b long")
    for dim in dims:
        found = found.unionByName(links_of(groups.where(F.col("dim") == dim), dim, cosine, codewords, recall, sample))
    found = written(found, "found")
    roots = components(found.where("a IS NOT NULL").select("a", "b"))
    counts = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    least = roots.join(groups, F.col("node") == F.col("num")).groupBy("root").agg(F.min("rep").alias("least"))
    roots = roots.join(least, "root").select("node", "least")
    known = groups.join(counts, F.col("num") == F.col("id"), "left").drop("id").join(roots, F.col("num") == F.col("node"), "left")
    known = written(known.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"), "copies"), "known")
    hot = known.where(F.col("copies") > max(1000, rows.count() * 1e-3))  # fewer than 1000 rows
    hot = F.broadcast(hot.select("vec", F.col("n_links").alias("hot_links"), F.col("component_id").alias("hot_component")))
    seen = rows.join(hot, "vec", "left")
    rest = seen.where("hot_links IS NULL").join(known.drop("copies"), "vec", "left").select("id", "n_links", "component_id")
    out = rest.unionByName(seen.where("hot_links IS NOT NULL").select("id", F.col("hot_links").alias("n_links"), F.col("hot_component").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def links_of(groups: DataFrame, dim: int, cosine: float, codewords: int | None, recall: float, sample: int) -> DataFrame:
    """Of vectors of one length, by their numbers: id, n (copies of other vectors that it links with), in other rows a, b (links that give the components)."""
    spark = groups.sparkSession
    some = groups.orderBy(F.xxhash64("rep"), F.xxhash64("vec")).limit(sample).select("vec").toPandas()["vec"]
    x = np.stack(some.to_numpy()).astype(float)
    k = codewords or int(min(1024, max(8, 2 ** round(np.log2(np.sqrt(groups.count()) / 4)))))
    index = spark.sparkContext.broadcast(fit(x / np.linalg.norm(x, axis=1, keepdims=True), cosine, k, recall))

    def unit(column: pa.Array) -> np.ndarray:
        x = np.asarray(column.flatten(), float).reshape(-1, dim)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(2))
                home, seen = own.cells(x), own.visits(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(home, pa.int64()), pa.array(seen, pa.list_(pa.int64())), batch.column(2)], ["num", "copies", "home", "cells", "vec"])

    kind = groups.schema["vec"].dataType.simpleString()
    placed = written(groups.select("num", "copies", "vec").mapInArrow(visit, f"num long, copies long, home long, cells array<long>, vec {kind}"), "placed")
    # cells are cut so that no task compares more than SIDE indexed vectors with about SIDE queries
    asked = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("query_parts"))
    cells = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("index_parts")).join(asked, "cell")
    cells = F.broadcast(cells)  # at most codewords ** 2 rows
    part = lambda n: F.pmod(F.xxhash64("num"), F.col(n)).cast("int")
    indexed = placed.withColumn("cell", F.col("home")).join(cells, "cell").withColumn("i", part("index_parts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    queries = placed.withColumn("cell", F.explode("cells")).join(cells, "cell").withColumn("j", part("query_parts")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("index_parts") - 1)))
    cols = ["cell", "i", "j", "num", "copies", "home", "cells", "vec"]
    dealt = indexed.select(*cols, F.lit(False).alias("asks")).unionByName(queries.select(*cols[:-2], F.lit(None).cast("array<long>").alias("cells"), "vec", F.lit(True).alias("asks")))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        num, copies, home = (table.column(c).to_numpy() for c in ("num", "copies", "home"))
        x = unit(table.column("vec").combine_chunks())
        q, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        homes, home_of = np.unique(home, return_inverse=True)
        mutual = np.zeros((len(num), len(homes)), bool)  # an indexed vector visits a query's cell, and so finds the link as well
        for i, own in zip(y.tolist(), table.column("cells").take(pa.array(y)).to_pylist(), strict=True):
            mutual[i] = np.isin(homes, own)
        count, a, b = np.zeros(len(num), np.int64), [], []
        for s in range(0, len(q), 512):
            for t in range(0, len(y), 1024):
                p, r = np.nonzero(x[q[s : s + 512]] @ x[y[t : t + 1024]].T >= cosine)
                p, r = q[p + s], y[r + t]
                apart = num[p] != num[r]
                p, r = p[apart], r[apart]
                np.add.at(count, p, copies[r])
                alone = ~mutual[r, home_of[p]]
                np.add.at(count, r[alone], copies[p[alone]])
                if len(p):
                    a_, b_ = forest(num[p], num[r])
                    a.append(a_)
                    b.append(b_)
        ends = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        hit = np.flatnonzero(count)
        columns = [(num[hit], 0), (count[hit], 0), (ends[0], 1), (ends[1], 1)]
        none = [pa.nulls(len(ends[0]), pa.int64()), pa.nulls(len(hit), pa.int64())]
        return pa.table({c: pa.concat_arrays([none[1], pa.array(v)] if last else [pa.array(v), none[0]]) for c, (v, last) in zip("id n a b".split(), columns, strict=True)})

    return dealt.groupBy("cell", "i", "j").applyInArrow(compare, "id long, n long, a long, b long")
