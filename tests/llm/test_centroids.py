import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import centroids, queries

from ..oracle import same

SMALL = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds, width, scale, seed):
    """Lloyd's rounds in whole numbers, all distances each time."""
    own = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1])
    means = [q for _, q in sorted(own, key=key)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in own]
        for j in range(len(means)):
            if some := [q for (_, q), c in zip(own, of) if c == j]:
                means[j] = [sum(x) // len(some) for x in zip(*some)]
    return sorted(((i is None, i or 0), *nearest(q)[::-1]) for i, q in own), means


@pytest.mark.parametrize("seed", range(4))
def test_clusters_by_brute_force(spark, seed, monkeypatch):
    """Few values and many ties, so that bounds meet; also vectors that don't count, repeated rows and null ids."""
    monkeypatch.setattr(centroids, "ROWS", 7)
    rnd = random.Random(seed)
    width, k, scale = rnd.choice([(1, 3, 2), (2, 4, 4), (3, 8, 1024), (2, 50, 1)])
    grid = rnd.choice([0.25, 0.5, 0.001])
    rows = [(i, [rnd.randint(-8, 8) * grid for _ in range(width)]) for i in range(40)]
    rows += [rows[3], (7, rows[9][1]), (None, [0.5] * width), (90, None), (91, [0.0] * (width + 1)), (92, [None] * width), (93, [math.nan] * width), (94, [math.inf] + [0.0] * (width - 1)), (95, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, q string, cluster int").repartition(3)
    out, means = centroids.clustered(df, k=k, rounds=5, width=width, scale=scale, seed=seed)
    want, want_means = plain_clusters(rows, k, 5, width, scale, seed)
    assert sorted(((r.id is None, r.id or 0), r.cluster, r.distance) for r in out.collect()) == want
    assert means.tolist() == want_means
    none, means = centroids.clustered(df.limit(0), width=width)
    assert none.count() == 0 and len(means) == 0


def test_bounds_hold_and_spare_scans():
    """After each move the bounds are on their sides of the true distances, clusters are the nearest ones, and most vectors aren't scanned."""
    rng = np.random.default_rng(5)
    q = np.concatenate([rng.integers(-60, 60, (300, 16)) + rng.integers(-900, 900, 16) for _ in range(8)])
    means = q[rng.choice(len(q), 8, replace=False)]
    cluster, upper, lower = centroids.scanned(q, means)
    scans = []
    for _ in range(10):
        after = np.array([q[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else means[j] for j in range(8)])
        cluster, upper, lower, full = centroids.assigned(q, cluster, upper, lower, centroids.Move.between(means, after))
        means = after
        d = centroids.exact(q, means)
        assert (cluster == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(q)), cluster])).all()
        d[np.arange(len(q)), cluster] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(1))).all()
        scans.append(full.mean())
    assert np.mean(scans) < 0.5 and scans[-1] < 0.05


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(df, width=1)


def test_query_has_the_rows_of_its_sql(spark):
    same(spark, queries.op12_hamerly_clusters, queries.OP12_SQL, SMALL)
