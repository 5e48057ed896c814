import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    """Letters of sf0.001's texts."""
    return toxicity.letters(queries.documents(spark, SMALL), "text")


def test_labels_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op11_noisy_channel_toxicity(spark, SF).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) > 0.9
    assert np.mean([r.predicted for r in held if not labels[r.doc_id]]) < 0.01


def test_letter_counts_by_loops(spark, model):
    words = {"ab": 2, "é1": 1, "": 5, "a-b": 3, "x y": 1, "(ab)": 4}
    want = np.zeros((toxicity.SYMBOLS,) * 3, int)
    for w, n in words.items():
        own = [0, 0, *map(toxicity.symbol, toxicity.bare(w)), 0] if toxicity.bare(w) else []
        for a, b, c in zip(own, own[1:], own[2:]):
            want[a, b, c] += n
    assert (toxicity.letter_counts(words).reshape(want.shape) == want).all()
    assert not toxicity.letter_counts({}).any()
    assert np.allclose(np.exp(model.astype(float)).sum(2), 1, atol=1e-4)


def plain_reading(word, model):
    """The likeliest reading among all of them."""
    best = (-math.inf, None)
    choices = []
    for t in range(len(word)):
        own, drop = toxicity.readings(word, t)
        choices.append([*own, (None, drop)])
    for picked in itertools.product(*choices):
        a, b, total, text = 0, 0, 0.0, ""
        for c, (s, cost) in zip(word, picked):
            total += cost
            if s is None:
                continue
            if s == toxicity.BORDER:
                total += model[a, b, 0] if b else 0
                a, b, text = 0, 0, text + " "
            else:
                total += model[a, b, s]
                a, b, text = b, s, text + (c if s >= toxicity.OTHER else chr(96 + s))
        total += model[a, b, 0] if b else 0
        best = max(best, (total, " ".join(text.split())))
    return best[0]


def score_of(word, reading, model):
    """The best score of readings of ``word`` that give ``reading``."""
    best = -math.inf
    for picked in itertools.product(*[[*toxicity.readings(word, t)[0], (None, toxicity.readings(word, t)[1])] for t in range(len(word))]):
        a, b, total, text = 0, 0, 0.0, ""
        for c, (s, cost) in zip(word, picked):
            total += cost
            if s is not None and s != toxicity.BORDER:
                total, a, b, text = total + model[a, b, s], b, s, text + (c if s >= toxicity.OTHER else chr(96 + s))
            elif s is not None:
                total, a, b, text = total + (model[a, b, 0] if b else 0), 0, 0, text + " "
        total += model[a, b, 0] if b else 0
        if " ".join(text.split()) == reading:
            best = max(best, total)
    return best


def test_viterbi_by_all_readings(model):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab1é!. -o0") for _ in range(rnd.randint(1, 6))) for _ in range(60)] + ["1d10t", "l.o.l", "aabb", "!d", "a", "-"]
    for w, r in zip(words, toxicity.decoded(words, model)):
        assert score_of(w, r, model) == pytest.approx(plain_reading(w, model), abs=1e-3), (w, r)


def test_disguised_words_are_read(spark):
    """Of words that the letters are known from, each disguise is undone."""
    plain = ["idiot", "moron", "stupid", "clown", "trash"]
    counts = toxicity.letter_counts({w: 50 for w in plain} | {"then": 100, "well": 100, "of": 100})
    letters = toxicity.letter_model(counts)
    for w in plain:
        signs = w.translate(str.maketrans("ioas", "1045"))
        for disguised in (w, signs, signs.upper() if signs != w else w, ".".join(w), " ".join(w), " ".join(signs), "".join(c * 3 for c in w), "".join(c * 2 for c in w), f"({signs}!!!", "-".join(signs), w + "###"):
            assert toxicity.read(toxicity.words_of(disguised), letters) == [w], disguised
    assert toxicity.words_of("a b") == ["a", "b"] and toxicity.words_of("x x x x then") == ["x", "then"] and toxicity.words_of("it i d d y of") == ["it", "i d d y", "of"]


def test_disguised_documents_score_as_plain_ones(spark):
    rnd = random.Random(7)
    common = ["then", "well", "offer", "shine", "under", "water", "lean", "mother"]
    text = lambda more: " ".join(rnd.choices(common, k=40) + more)
    docs = [(i, text([rnd.choice(["moron", "stupid"])] if i % 3 == 0 else [])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    test = [(1000, text(["m0r0n"])), (1001, text(["s t u p i d"])), (1002, text(["s.t.u.p.1.d"])), (1003, text(["MMMOOORRROOONNN!!"])), (1004, text([])), (1005, text(["st0p", "5.5"])), (1006, ""), (1007, None)]
    own = spark.createDataFrame(docs + test, "doc_id long, text string")
    fitted = toxicity.fit(own, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(own, fitted).collect()}
    assert all((scores[i] >= 0.5) == (i % 3 == 0) for i, _ in docs)
    assert [scores[i] >= 0.5 for i in range(1000, 1008)] == [True] * 4 + [False] * 4


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", None), (None, None, 1.0), (2, "", 2.0), (3, "x " * 30000 + "y" * 3000 + "1", None)], "doc_id long, text string, score_ double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, some), kept=["doc_id", "text", "score_"], restored_col="as_read")
    assert out.columns == ["doc_id", "text", "score_", "score", "as_read"] and out.count() == 5
    assert [r.as_read for r in out.where("doc_id = 1").collect()] == ["a b"] * 2
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), some).lexicon == {}
