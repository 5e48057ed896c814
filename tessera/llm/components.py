"""Connected components of links that are a table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the least node that it is connected to here."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    apart = label != np.arange(len(nodes))
    return nodes[label[apart]], nodes[apart]


def thinned(links: DataFrame) -> DataFrame:
    """A forest of each partition's links (a, b): as many links as nodes at most, with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = forest(np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of the links (a, b): root is the least node of its component. Links may repeat or be loops.

    Each round hooks every node to its least neighbour, follows hooks twice, and renames the links' ends by them; links
    within a node go. The number of nodes at least halves, so that rounds grow with the logarithm of the longest path. Nodes
    that many links end at are looked up by broadcast.
    """
    left = written(thinned(links.where("a <> b")), "links")
    hooks = []
    while n := left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"), F.count(F.lit(1)).alias("links")), "first-hooks")
        hot = first.where(F.col("links") > max(1000, n * 1e-3)).select("node", "to")  # fewer than 2000
        hook = first.select("node", "to")
        for _ in range(2):
            hook = joined(hook.withColumnRenamed("to", "end"), first.select(F.col("node").alias("end"), "to"), "end", hot.withColumnRenamed("node", "end")).select("node", "to")
        hook = written(hook, "hooks")
        hooks.append(hook)
        hot = hot.select("node").join(hook, "node")
        for c in ("a", "b"):
            left = joined(left.withColumnRenamed(c, "node"), hook, "node", hot).drop("node").withColumnRenamed("to", c)
        left = written(thinned(left.where("a <> b").distinct()), "links")
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].withColumnRenamed("to", "root")
    for hook in hooks[1:]:
        ends = out.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        hot = ends.where(F.col("n") > max(1000, hooks[0].count() * 1e-3)).join(hook.withColumnRenamed("node", "root"), "root").select("root", "to")
        out = joined(out, hook.withColumnRenamed("node", "root"), "root", hot, "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(out, "components")
