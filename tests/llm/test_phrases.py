import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import phrases, queries

from ..oracle import same

SMALL = "/root/testdata/sf0.001"


def plain_ends(words, piece, group, depth):
    """Where each run ends, by loops; the empty run of each group ends at all its words."""
    ends = defaultdict(set)
    for i in range(len(words)):
        ends[group[i], ()].add(i)
        for k in range(1, depth + 1):
            if i - k + 1 >= 0 and piece[i - k + 1] == piece[i]:
                ends[group[i], tuple(words[i - k + 1 : i + 1])].add(i)
    return ends


@pytest.mark.parametrize("seed", range(200))
def test_automaton_by_brute_force(seed):
    rnd = random.Random(seed)
    n, most, depth = rnd.randint(0, 60), rnd.choice([1, 2, 3, 8]), rnd.choice([1, 2, 3, 4, 5])
    piece = np.cumsum([rnd.random() < 0.15 for _ in range(n)]).astype(int)
    of = [rnd.randint(0, 2) for _ in range(100)]
    group, words = np.array([of[p] for p in piece], int), np.array([rnd.randint(0, most - 1) for _ in range(n)], int)
    own = phrases.Automaton.of(words, piece, group, depth)
    want = plain_ends(words.tolist(), piece.tolist(), group.tolist(), depth)
    found = {}
    for k, end, ends in own.runs():
        for e, c in zip(end.tolist(), ends.tolist()):
            run = (group[e], tuple(words[e - k + 1 : e + 1].tolist()))
            assert run not in found
            found[run] = c
    assert found == {k: len(v) for k, v in want.items()}
    # a state for each class of runs that end at the same places, and links that lead to the longest suffix with more ends
    assert sum(own.length > 0) == len({(k[0], frozenset(v)) for k, v in want.items() if k[1]})
    for s in np.flatnonzero(own.length):
        e = own.end[s]
        run = tuple(words[e - own.length[s] + 1 : e + 1].tolist())
        suffix = next(run[i:] for i in range(1, len(run) + 1) if i == len(run) or want[group[e], run[i:]] != want[group[e], run])
        t, f = own.link[s], own.end[own.link[s]]
        assert own.length[t] == len(suffix) and tuple(words[f - len(suffix) + 1 : f + 1].tolist()) == suffix and group[f] == group[e]


def test_words_and_pieces():
    words, piece, text = phrases.words_of(["A b.c", None, "", "É-x\td;", "ü z\x0b\x01"])
    assert words.to_pylist() == ["a", "b", "c", "É-x", "d", "ü", "z", "\x01"]
    assert text.tolist() == [0, 0, 0, 3, 3, 4, 4, 4] and len(set(zip(text.tolist(), piece.tolist()))) == 5
    assert len(phrases.words_of([])[1]) == len(phrases.words_of([None, " .,"])[1]) == 0


def plain_collocations(rows, most_words, least, most, covered):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for p in text.split("\n"):
            w = [x for x in "".join(c.lower() if c < "\x80" else c for c in p).replace("\t", " ").split(" ") if x]
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    out = []
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in found.items():
        holds = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
        if any(g == lang and len(v) > len(w) and holds(v) and 100 * b >= covered * a for (g, v), b in found.items()):
            continue
        scored = [(1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(scored)
        out.append((lang, -s, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], total[lang]))
    ranked = defaultdict(list)
    for x in sorted(out):
        ranked[x[0]].append(x)
    return sorted((g, i + 1, p.decode(), -a, left, r, n, -s) for g, xs in ranked.items() for i, (_, s, a, p, left, r, n) in enumerate(xs[:most]))


@pytest.mark.parametrize("most_words,least,most,covered", [(3, 2, 1000, 50), (4, 2, 7, 80), (2, 1, 5, 50), (5, 3, 30, 20)])
def test_collocations_by_brute_force(spark, monkeypatch, most_words, least, most, covered):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    monkeypatch.setattr(phrases, "ROWS", 7)
    rnd = random.Random(most_words)
    texts = [" ".join(rnd.choice(["a", "b", "c", "B.", "d,", "é", "a b c", "\t"]) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(i, t, rnd.choice(["en", None, "und", "fr"]), i, "x") for i, t in enumerate(texts)] + [(None, None, "en", 1, None), (5, "", None, 2, ""), (6, "a b " * 3000, "long", 3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int, phrase string").repartition(5)
    out = phrases.collocations(docs, most_words, least, most, covered)
    assert sorted(map(tuple, out.collect())) == plain_collocations([(r[2], r[1]) for r in rows], most_words, least, most, covered)
    assert phrases.collocations(docs.limit(0), most_words, least, most, covered).count() == 0


def test_counts_beyond_64_bits(spark, monkeypatch):
    """Products of a million million occurrences are exact."""
    big = 3 * 10**12 + 1
    schema = "lang string, k int, phrase string, f long"
    rows = [("en", 0, "", 7 * big), ("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 5)]
    monkeypatch.setattr(phrases, "counted", lambda docs, lengths, *_: docs.sparkSession.createDataFrame([r for r in rows if r[1] in lengths], schema))
    (r,) = phrases.collocations(spark.range(0)).collect()
    assert r.score == 10**6 * (big - 5) ** 2 // (big * (big + 2)) and (r.l, r.r, r.n) == (big, big + 2, 7 * big)


def test_pairs_in_the_filter(spark):
    """No pair is lost, also where cells are few."""
    words = ["a", "b", "é", "long-word"]
    pairs = spark.createDataFrame([(g, f"{a} {b}") for g in ("en", "", "x") for a in words for b in words if a <= b], "lang string, phrase string")
    bits = phrases.pair_filter(pairs, 1 << 16)
    docs = spark.createDataFrame([(g, "a b é é. long-word long-word") for g in ("en", "", "x")], "lang string, text string")
    some = {(r.lang, r.phrase): r.f for r in phrases.counted(docs, range(3, 5), "lang", "text", bits).groupBy("lang", "phrase").agg({"f": "sum"}).withColumnRenamed("sum(f)", "f").collect()}
    assert some == {(g, p): 1 for g in ("en", "", "x") for p in ("a b é", "b é é", "a b é é")}
    none = phrases.pair_filter(pairs.limit(0), 1 << 16)
    assert not none.any() and phrases.counted(docs, range(3, 5), "lang", "text", none).count() == 0


def test_query_has_the_rows_of_its_sql(spark):
    same(spark, queries.op13_phrase_automata, queries.OP13_SQL, SMALL)
