import random
import time
from collections import Counter

import numpy as np
import pytest

from tessera.llm import components, exact, near, queries, shards, vectors
from tests.oracle import same

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a b", "x"), (1, "a b", "x"), (2, "ab", "y"), (None, "a b", None), (3, None, "z"), (4, "", "z"), (5, "  ", "q"), (6, "solo", None)]
SCHEMA = "doc_id long, text string, digest string"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_has_the_rows_of_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


@pytest.mark.parametrize("cells", [1 << 16, 8])
def test_exact_groups(spark, cells):
    """With 8 cells all rows may repeat, and the result is the same."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df, most_cells=cells).collect())
    assert got == [(0, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True)]
    assert sorted(map(tuple, exact.without_copies(df, most_cells=cells).collect())) == [(1, "a b", "x"), (5, "  ", "q"), (6, "solo", None)]
    assert exact.exact_groups(df.limit(0)).count() == exact.without_copies(df.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 else "é") for i in range(100)], "id long, text string")
    table = shards.ShardTable(spark, str(tmp_path / "s"), df.schema, target_bytes=1 << 20, fan_in=3)
    assert table.read().count() == 0
    for i in range(4):
        table.append(df.where(f"id % 4 = {i}").coalesce(1))
    before = table.version()
    assert before == 4 and len(table.manifest()) == 4
    assert table.compact() == 5 and len(table.manifest()) == 1
    assert table.read(before).count() == 100 and len(table.manifest(before)) == 4
    assert table.vacuum() == 0  # younger than a day
    assert table.vacuum(older_than=0) == 4 and sorted(table.read().collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        table.commit(4, [])  # version 5 is there
    assert shards.shard(df.limit(0), str(tmp_path / "e")).read().count() == 0


def test_arrivals_are_merged_whatever_the_files(spark, tmp_path, monkeypatch):
    """The registered query, over a table of one file: each arrival is a version, and merges follow."""
    made = []
    plain = shards.shard
    monkeypatch.setattr(shards, "shard", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    rows = queries.op6_tiered_shards(spark, SF).collect()
    table = made[0]
    versions = [table.manifest(v) for v in range(1, table.version() + 1)]
    assert len(versions) > 8 and [len(v) for v in versions[:8]] == list(range(1, 9)) and len(versions[-1]) < 4
    assert all(sum(s.rows for s in v) <= len(rows) for v in versions[:8]) and sum(s.rows for s in versions[-1]) == len(rows) == rows[0].manifest_rows
    own = spark.range(200_000, numPartitions=4).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS arrival0", "IF(id % 7 = 0, NULL, id) AS arrival1")
    table = plain(own, str(tmp_path / "t"), arrivals=6, target_bytes=1 << 20, fan_in=3)
    full = [s.bytes for s in table.manifest() if table.tier(s) == 0]
    assert table.version() > 6 and len(full) > 5 and all((1 << 19) <= x <= (1 << 21) for x in full) and len(table.manifest()) - len(full) < 8
    assert sum(s.rows for s in table.manifest()) == 200_000 and table.read().exceptAll(own).isEmpty()


def test_two_writers(spark, tmp_path):
    """Each loses once: an append while another one commits, and a merge while a third commits."""
    df = spark.createDataFrame([(i, "t") for i in range(60)], "id long, text string")
    a, b = (shards.ShardTable(spark, str(tmp_path / "s"), df.schema, target_bytes=1 << 20, fan_in=3) for _ in range(2))
    write, meanwhile = a.write, []

    def slow_write(rows):
        out = write(rows)
        for some in meanwhile:
            b.append(some)
        meanwhile.clear()
        return out

    a.write = slow_write
    meanwhile.append(df.where("id % 3 = 1").coalesce(1))
    base = a.version
    a.version = lambda: 0 if not meanwhile and base() == 1 and len(seen) == 0 and not seen.append(1) else base()  # reads the version before the other's commit
    seen: list = []
    a.append(df.where("id % 3 = 0").coalesce(1))
    a.version = base
    assert a.version() == 2 and a.read().count() == 40
    a.append(df.where("id % 3 = 2 AND id < 30").coalesce(1))
    meanwhile.append(df.where("id % 3 = 2 AND id >= 30").coalesce(1))
    a.compact()
    assert sorted(b.read().collect()) == sorted(df.collect()) and len(b.manifest()) == 2


def test_filter_by_blocks(spark, monkeypatch):
    """Many blocks, and a few cells, find all that repeats."""
    monkeypatch.setattr(exact, "BLOCK", 64)
    monkeypatch.setattr(exact, "BLOCKS", 32)
    df = spark.createDataFrame([(i, f"text {i % 300}" if i % 2 else f"own {i}") for i in range(1200)], "doc_id long, text string").repartition(7)
    want = Counter(t.replace(" ", "") for _, t in df.collect())
    for cells in (1 << 16, 1 << 11, 64):
        own = exact.digests(df, "doc_id", "text")
        bits = exact.repeated_cells(own, cells)
        flags = {bytes(r.digest): r.may_repeat for r in exact.flagged(own, bits).collect()}
        from hashlib import sha256

        assert all(flags[sha256(t.encode()).digest()] for t, n in want.items() if n > 1)
    assert sum(exact.exact_groups(df, most_cells=1 << 11).where("kept").select("group_size").toPandas().group_size) == 1200


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    """Families of copies with one to many edits, a passage that many share, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(4, 90))]
        for _ in range(rnd.randrange(1, 15)):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = word()
            out.append(own)
    out += [passage + [word() for _ in range(rnd.randrange(0, 40))] for _ in range(25)]
    out += [[], [word()], passage[:2], passage[:2], passage[:3]]
    rnd.shuffle(out)
    return [(i, rnd.choice([" ", "\n"]).join(w).title() if w else None) for i, w in enumerate(out)]


@pytest.mark.parametrize("width,num,den,block", [(4, 85, 100, 32 << 20), (5, 80, 100, 2000), (1, 60, 100, 32 << 20)])
def test_near_copies_by_brute_force(spark, monkeypatch, width, num, den, block):
    """Small blocks are searched pair of parts by pair of parts."""
    monkeypatch.setattr(near, "BLOCK_BYTES", block)
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(df, width, num, den).collect()}
    want = brute(rows, width, num, den)
    assert got == want
    kept = {r.doc_id for r in near.without_near_copies(df, width, num, den).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "q"), (2, "A b c", None), (3, None, "q"), (4, "", "q"), (5, "a b c d", "k"), (None, "a b c", "q"), (6, "x y z w q", "q"), (6, "x y z w q", "q")], "doc_id long, text string, digest string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near.jaccard_components(df).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (6, 1, 6)]
    assert near.jaccard_components(df.limit(0)).count() == near.without_near_copies(df.limit(0)).count() == 0
    assert near.without_near_copies(df).columns == df.columns


def test_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, "short text"), (4, long.replace(" ", "\n"))], "doc_id long, text string")
    assert sorted(map(tuple, near.jaccard_components(df).collect())) == [(1, 119_996, 1), (2, 119_997, 1), (3, 1, 3), (4, 119_996, 1)]
    assert sorted((r.doc_id, r.keep_id) for r in exact.exact_groups(df).collect()) == [(1, 1), (2, 2), (3, 3), (4, 1)]
    assert sorted(shards.shard(df, str(tmp_path / "s")).read().collect()) == sorted(df.collect())


def test_bucket_count_follows_the_size(spark, monkeypatch):
    """With more buckets than tasks the rows are the same."""
    monkeypatch.setattr(near, "BUCKET_BYTES", 500)
    rows = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_divide_skip_finds_what_counting_finds():
    rnd = random.Random(3)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(60), rnd.randrange(0, 40))) for _ in range(rnd.randrange(1, 12))]
        least = rnd.randrange(1, 8)
        want = {v: n for v, n in Counter(x for own in lists for x in own).items() if n >= least}
        assert dict(near.divide_skip(lists, least)) == want
        assert dict(near.merge_skip(lists, least)) == want


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def linked(sets, num, den):
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), code.max() + 1), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), code] = 1
    both, size = has @ has.T, has.sum(1)
    return den * both >= num * (size[:, None] + size - both)


@pytest.mark.parametrize("dense", [16, 1, 100])
def test_search_by_brute_force(monkeypatch, dense):
    """Blocks of families with words that many share, by bitmaps and by short lists."""
    monkeypatch.setattr(near, "DENSE", dense)
    rng = np.random.default_rng(dense)
    for t in range(60):
        families = [rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        common, sets = rng.integers(0, 1 << 63, 20).astype(np.uint64), []
        for _ in range(rng.integers(1, 100)):
            own = families[rng.integers(len(families))].copy()
            k = rng.integers(0, 1 + len(own) // 4)
            own[rng.integers(0, len(own), k)] = rng.choice(common, k) if rng.random() < 0.5 else rng.integers(0, 1 << 63, k).astype(np.uint64)
            sets.append(np.unique(own))
        sets.sort(key=len)
        num, den = [(85, 100), (80, 100), (60, 100), (1, 1), (30, 100)][t % 5]
        a, b = near.search(sets, num, den)
        link = linked(sets, num, den)
        assert link[a, b].all() and len(a) < len(sets)
        assert roots_of(len(sets), zip(a, b, strict=True)) == roots_of(len(sets), np.argwhere(link))


def test_near_copies_that_hardly_link_are_searched_in_little_time():
    """1500 copies of a passage, of which many link with none: walking the lists of each takes minutes, and four times that for twice as many."""
    rng = np.random.default_rng(2)
    base, sets = rng.integers(0, 1 << 63, 400).astype(np.uint64), []
    for _ in range(1500):
        own, k = base.copy(), rng.integers(4, 50)
        own[rng.choice(400, k, replace=False)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
        sets.append(np.unique(own))
    began = time.process_time()
    a, b = near.search(sets, 85, 100)
    assert time.process_time() - began < 10
    assert roots_of(1500, zip(a, b, strict=True)) == roots_of(1500, np.argwhere(linked(sets, 85, 100)))


def test_texts_are_read_again_by_id(spark):
    """Sets are made of rows that the filter of ids may have, equal ones once; no other text is cut into shingles again."""
    df = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "p q r s t"), (None, "u v w x"), (4, None)], "id long, text string").coalesce(1)
    wanted = exact.repeated_cells(df.where("id IS NULL OR id IN (1, 2, 4)").select(near.digest("id")), 1 << 16, 1)
    assert sorted(r.n for r in near.candidate_sets(df, 4, wanted).collect()) == [1, 2]


def test_chunks_go_to_buckets_together():
    """What tasks send has a row a bucket for some chunks, not for each."""
    chunks = [(np.zeros(n, np.uint64), list(range(texts))) for n, texts in [(3, 1), (4, 1), (4, 1), (20, 1), (1, 40_000), (1, 30_000)]]
    assert [[len(p[0]) for p in parts] for parts in near.grouped(iter(chunks), 10)] == [[3, 4], [4], [20], [1], [1]]
    assert list(near.grouped(iter([]))) == [] and near.GROUP >= 4 * near.CHUNK


def test_components_of_hubs(spark):
    """Ends of more than a thousand links come by broadcast."""
    rnd = random.Random(5)
    links = [(5, x) for x in range(10, 2500)] + [(x, 9000) for x in range(3000, 4500)] + [(2499, 3000), (7000, 7001), (7001, 6999)]
    rnd.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: (6999 if 6999 <= x <= 7001 else 5) for pair in links for x in pair}


def test_many_copies_by_brute_force(spark):
    rows = [(i, "one two three four five six") for i in range(1500)] + [(2000 + i, f"a b c d e f {i}") for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (2, 0) if i < 1500 else (3, i) for i, _ in rows}


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {x: x for pair in links for x in pair}
    for _ in range(70):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: v for k, v in want.items() if k != 300}


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + 0.16 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16)), np.repeat(base[:2], 20, 0)])
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rep string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    rows = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    found = np.array([rows[i].n_links for i in range(len(x))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.99 * link.sum()
    if found.sum() == link.sum():
        want = np.arange(len(x))
        for _ in range(30):
            want = np.array([min(want[i], want[link[i]].min(initial=i)) for i in range(len(x))])
        assert [rows[i].component_id for i in range(len(x))] == want.tolist()


def test_recall_on_the_table(spark):
    """The registered query finds what comparing all with all finds."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    found = {r.vec_id: r.n_links for r in queries.op3_multi_index(spark, "/root/testdata/sf0.01").collect()}
    assert all(found[i] <= n for i, n in zip(rows.vec_id, link.sum(1))) and sum(found.values()) >= 0.99 * link.sum()


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (7, [1.0, 0.01]), (7, [1.0, 0.01]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 3, 1, False), (7, 3, 1, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_an_id_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [0.0, 1.0]), (2, [0.01, 1.0]), (None, [-1.0, 0.0]), (3, [0.0, -1.0]), (3, [-0.7, -0.7])]
    got = [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(1, 1, 1, True), (1, 1, 1, True), (None, 1, 2, None), (2, 1, 2, True), (None, 0, None, None), (3, 0, 3, True), (3, 0, 3, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
