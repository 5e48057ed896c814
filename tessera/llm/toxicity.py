"""A toxicity classifier that reads disguised words as what they stand for (a noisy channel).

The channel writes a letter as a sign that looks like it, sets marks or spaces between letters, and repeats letters. A word that may be
so written becomes a lattice of what each of its characters can stand for; Viterbi finds the likeliest reading under a model of three
letters at a time, which is counted over all texts. Restored words are looked up in a lexicon of words and beginnings of words that are
far more frequent in toxic documents than in others, and a document's hits and their rate make its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, remainder, with_text, written
from .pieces import chunks

#: Symbols of the letter model: a border, a to z, any other letter, a digit.
BORDER, OTHER, DIGIT, SYMBOLS = 0, 27, 28, 29
#: Letters that a sign is written for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Natural logarithms of what the channel does in a word that may be disguised: a sign or digit for a letter, a mark or space between letters of a
#: word, a letter again; and of what is rare there: a digit as itself, words that a sign or single characters part.
SIGN, JOIN, AGAIN, NUMBER, BREAK = (math.log(p) for p in (0.5, 0.5, 0.5, 0.02, 1e-5))
#: Readings of a character, at most.
READINGS = 3
#: Characters of a lattice, at most: longer words are read in parts, as no word is that long.
LONGEST = 512
#: Words that are remembered, and lattices that are decoded side by side.
CACHED_WORDS, SIDE_BY_SIDE = 500_000, 256
#: Labelled documents that the lexicon and the score are learned from, at most.
SAMPLE = 20_000
#: Lengths of beginnings of words in the lexicon; entries, at most; how sure an entry must be, in standard deviations.
BEGINNINGS = range(3, 9)
ENTRIES, SURE = 4096, 4.0
#: A letter that is repeated.
TWICE = re.compile(r"(\w)\1+")
#: Marks that words lose at their ends.
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¿¡“”‘’…–—"


#: Signs for letters that a word may begin with.
LEFT = OUTER.translate({ord(c): None for c in "@$!|"})


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else DIGIT if c.isdigit() else OTHER if c.isalpha() else BORDER


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space, as they stand. Three or more single characters in a row are one word that has spaces in it,
    where more than two equal ones count as one."""
    own = (text or "").lower().split()
    alone = np.fromiter(map(len, own), np.int64, len(own)) == 1
    if np.count_nonzero(alone) < 3:
        return own
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alone.astype(np.int8), [0]]))).tolist()
    for a, b in zip(edge[-2::-2], edge[:0:-2], strict=True):  # from the last, so that places stay
        if b - a > 2:
            kept = [w for w, same in groupby(own[a:b]) for _ in range(2 if len(list(same)) == 2 else 1)]
            own[a:b] = [" ".join(kept)] if len(kept) > 2 else kept
    return own


def bare(word: str) -> str:
    """Without outer marks, but with signs for letters at its beginning."""
    return word.lstrip(LEFT).rstrip(OUTER)


def odd(word: str) -> bool:
    """Whether a word can be disguised: letters and something else, or letters that are repeated, most of them or one more than twice."""
    if not word.isalpha():
        return any(map(str.isalpha, word))
    twice = [a == b for a, b in zip(word, word[1:])]
    return any(a and b for a, b in zip(twice, twice[1:])) or 3 * sum(twice) > len(word)


def letter_counts(words: dict[str, int]) -> np.ndarray:
    """How often each symbol follows two others, over words with their counts; two borders come before a word, and one after it."""
    out = np.zeros(SYMBOLS**3, np.int64)
    own: Counter = Counter()
    for w, n in words.items():
        own[bare(w)] += n
    own.pop("", None)
    words = own
    if not words:
        return out
    text = "\0\0" + "\0\0".join(words) + "\0"
    points, which = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    s = np.array([symbol(chr(p)) for p in points], np.int64)[which]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(size + 1) - (size + 1) + 2  # of each word's first letter
    at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), size)
    triples = (s[at - 2] * SYMBOLS + s[at - 1]) * SYMBOLS + s[at]
    return np.bincount(triples, weight, len(out)).astype(np.int64)


def letter_model(counts: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Logarithms of the chance of a symbol after two others, each order with the one below it as prior."""
    three = counts.reshape((SYMBOLS,) * 3).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p = (one + 1) / (one.sum() + SYMBOLS)
    p = (two + prior * p) / (two.sum(1, keepdims=True) + prior)
    p = (three + prior * p[None]) / (three.sum(2, keepdims=True) + prior)
    return np.log(p).astype(np.float32)


def readings(word: str, t: int) -> tuple[list[tuple[int, float]], float]:
    """What a word's character can stand for, with costs, and the cost of its standing for nothing."""
    c = word[t]
    own, signs = symbol(c), [(symbol(x), SIGN) for x in LOOKS_LIKE.get(c, "")]
    if own == BORDER:
        alone = signs or any(0 <= a < len(word) and not (0 <= b < len(word) and symbol(word[b])) for a, b in ((t - 1, t - 2), (t + 1, t + 2)))
        return [(own, BREAK if alone else 0.0), *signs], BREAK if signs else JOIN
    return [(own, NUMBER if own == DIGIT else 0.0), *signs], AGAIN if t and word[t - 1] == c else -math.inf


def decoded(words: list[str], model: np.ndarray) -> list[str]:
    """The likeliest reading of each word, by Viterbi; states are the last two symbols. A border is read as a space."""
    out = [""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        n = 1
        while n < SIDE_BY_SIDE and at + n < len(order) and (n + 1) * len(words[order[at + n]]) <= SIDE_BY_SIDE * 32:
            n += 1
        some = order[at : at + n]
        for i, r in zip(some, side_by_side([words[i] for i in some], model), strict=True):
            out[i] = r
        at += n
    return out


def side_by_side(words: list[str], model: np.ndarray) -> list[str]:
    n, most = len(words), max(map(len, words))
    sym, cost, drop = np.full((most, n, READINGS), -1), np.full((most, n, READINGS), -np.inf, np.float32), np.zeros((most, n), np.float32)
    for i, w in enumerate(words):
        for t in range(len(w)):
            own, drop[t, i] = readings(w, t)
            for k, (x, y) in enumerate(own):
                sym[t, i, k], cost[t, i, k] = x, y
    ending = model[:, :, BORDER].copy()
    ending[:, BORDER] = 0  # a border after a border
    after = np.ascontiguousarray(model.transpose(2, 1, 0))  # by the symbol, the last one, the one before
    score = np.full((n, SYMBOLS, SYMBOLS), -np.inf, np.float32)  # by the last symbol, the one before
    score[:, BORDER, BORDER] = 0
    came, border_came, dropped = np.zeros((most, n, READINGS, SYMBOLS), np.uint8), np.zeros((most, n), np.int32), np.zeros((most, n, SYMBOLS, SYMBOLS), bool)
    rows = np.arange(n)
    for t in range(most):
        new = np.full_like(score, -np.inf)
        for k in range(READINGS):
            own = rows[sym[t, :, k] > BORDER]
            if len(own):
                s = sym[t, own, k]
                whole = score[own] + after[s]
                arg = whole.argmax(2)
                came[t, own, k] = arg
                new[own, s] = np.take_along_axis(whole, arg[:, :, None], 2)[:, :, 0] + cost[t, own, k, None]
        own = rows[sym[t, :, 0] == BORDER]
        if len(own):
            whole = (score[own] + ending.T).reshape(len(own), -1)
            border_came[t, own] = arg = whole.argmax(1)
            new[own, BORDER, BORDER] = whole[np.arange(len(own)), arg] + cost[t, own, 0]
        stay = score + drop[t, :, None, None]
        dropped[t] = stay > new
        score = np.maximum(stay, new)
    whole = (score + ending.T).reshape(n, -1)
    last = whole.argmax(1)
    out = []
    for i, w in enumerate(words):
        b, a = divmod(int(last[i]), SYMBOLS)
        read: list[str] = []
        for t in range(most - 1, -1, -1):
            if dropped[t, i, b, a]:
                continue
            if b == BORDER:
                b, a = divmod(int(border_came[t, i]), SYMBOLS)
                read.append(" ")
            else:
                k = sym[t, i].tolist().index(b)
                read.append(w[t] if b >= OTHER else chr(96 + b))
                b, a = a, int(came[t, i, k, a])
        out.append(" ".join("".join(reversed(read)).split()))
    return out


def read(words: list[str], model: np.ndarray) -> list[str]:
    """What words, as they stand in a text, are read as: a word, or several with spaces between them, in letters that aren't repeated."""
    out = [bare(w) for w in words]
    some = [i for i, w in enumerate(out) if not w.isalpha() or TWICE.search(w)]
    parts = {i: [out[i][j : j + LONGEST] for j in range(0, len(out[i]), LONGEST)] for i in some if odd(out[i])}
    done = iter(decoded([p for x in parts.values() for p in x], model))
    for i in some:
        out[i] = TWICE.sub(r"\1", " ".join(next(done) for _ in parts[i]) if i in parts else out[i])
    return out


class Reader:
    """Remembers what words are read as."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, str] = {}

    def __call__(self, words: list[str]) -> list[str]:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new = {}, list(set(words))
        self.known.update(zip(new, read(new, self.model), strict=True))
        return [self.known[w] for w in words]


def entries(word: str) -> list[str]:
    """What the lexicon can have of a word: itself, and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


@dataclass
class Model:
    """letters: as ``letter_model`` gives them; lexicon: weights of entries; weights: of a document's numbers, as ``numbers`` has them."""

    letters: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(NUMBERS))


NUMBERS = 6


class Scorer:
    """Scores texts. A word's weight is the largest of its entries', 0 without any."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}
        self.heads = {e[: BEGINNINGS[0]] for e in model.lexicon}

    def weight(self, found: str) -> float:
        if " " not in found and found[: BEGINNINGS[0]] not in self.heads:
            return 0.0
        return max((self.model.lexicon.get(e, 0.0) for w in found.split() for e in entries(w)), default=0.0)

    def numbers(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: 1, logarithms of hits, of their weights and of words, the largest weight, and whether hits are more than a
        hundredth of the words. What is new in all texts is read together."""
        split = [words_of(t) for t in texts]
        missing = list(set().union(*split).difference(self.known))
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known, missing = {}, list(set().union(*split))
        self.known.update(zip(missing, map(self.weight, read(missing, self.model.letters)), strict=True))
        out = np.zeros((len(texts), NUMBERS))
        for i, words in enumerate(split):
            hits = [w for w in map(self.known.__getitem__, words) if w]
            out[i] = 1, math.log1p(len(hits)), math.log1p(math.fsum(hits)), math.log1p(len(words)), max(hits, default=0.0), len(hits) * 100 > len(words)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.numbers(texts) @ self.model.weights, -30, 30)))


def letters(docs: DataFrame, text_col: str) -> np.ndarray:
    """The letter model of all texts. What comes to the driver is a row for three symbols at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(SYMBOLS**3, np.int64), Counter()
        for batch in batches:
            for texts in chunks(batch.column(0).to_pylist()):
                for t in texts:
                    words.update(words_of(t))
                if len(words) > CACHED_WORDS // 2:
                    total, words = total + letter_counts(words), Counter()
        total += letter_counts(words)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["at", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for at, n in docs.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return letter_model(out)


def lexicon(sample: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Entries that toxic documents of ``sample`` (text, label) have more often than others do, with their weights: the logarithm of the ratio of
    odds, where the root of the likelihood ratio is SURE or more, as standard deviations are; the ENTRIES surest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(model), [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            names = list(found[0] | found[1])
            rows = [pa.array([f[e] for e in names], pa.int64()) for f in found]
            found[:] = [Counter(), Counter()]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *rows], ["entry", "n0", "n1"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found[int(label)]
                own.update({e for found_as in set(reader(list(set(words_of(text))))) for w in found_as.split() for e in entries(w)})
                own[""] += 1
                if len(found[0]) + len(found[1]) > CACHED_WORDS // 2:
                    yield out()
        yield out()

    counts = sample.select("text", "label").mapInArrow(run, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = (sample.where(f"label = {k}").count() + 1.0 for k in (0, 1))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    ratio = F.log((n1 + 0.5) / (all1 - n1)) - F.log((n0 + 0.5) / (all0 - n0))
    own, rest = n0 + n1, all0 + all1 - 2 - n0 - n1
    table = ((n0, own, all0 - 1), (n1, own, all1 - 1), (all0 - 1 - n0, rest, all0 - 1), (all1 - 1 - n1, rest, all1 - 1))
    spread = sum((F.when(o > 0, 2 * o * F.log(o * (all0 + all1 - 2) / (row * side))).otherwise(0.0) for o, row, side in table), F.lit(0.0))
    found = counts.where("entry <> ''").select("entry", ratio.alias("w"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sure")).where((F.col("sure") >= SURE) & (F.col("w") >= 1))
    return {r["entry"]: r["w"] for r in found.orderBy(F.desc("sure"), "entry").limit(ENTRIES).collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Newton's method; the constant is not shrunk."""
    w, shrunk = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrunk[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrunk), x.T @ (p - y) + shrunk * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Letters are counted over all texts. Lexicon and weights come from at most ``sample`` labelled documents whose crc32 of the id as text isn't 0
    modulo ``folds``, the first by a hash of their ids. Null labels and ids don't count, and of an id's labels the highest does. Without
    any label each score is 1/2."""
    frugal(docs.sparkSession)
    model = Model(letters(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, folds) != 0))
    some = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    own = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "label"), "labelled")
    model.lexicon = lexicon(own, model.letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([pa.array(scorer.numbers(batch.column(0).to_pylist()).tolist()), batch.column(1)], ["x", "label"])

    rows = own.mapInArrow(run, "x array<double>, label int").orderBy(F.xxhash64("x"), "x", "label").limit(2 * sample).collect()
    if rows:
        model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None, restored_col: str | None = None) -> DataFrame:
    """Per row: ``id_col`` (or the columns ``kept``), score: 0 to 1, higher where label 1 is likelier; with ``restored_col`` also the text's words as read.

    A null or empty text has no words, and a score. White space is what Unicode calls so; upper case doesn't matter. Words beyond LONGEST characters are
    read in parts. Rows count each, whatever their ids; only ``text_col`` is an input of the score. An empty table gives no rows;
    ``kept`` may have columns of any name but those that are added.
    """
    kept = kept or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, kept, strict=True)] + [T.StructField("score", T.DoubleType())])
    if restored_col:
        schema.add("restored", T.StringType())
    rows, at = with_text(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        reader = Reader(shared.value.letters)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(at).to_pylist()):
                more = [pa.array([" ".join(reader(words_of(t))) for t in texts], pa.string())] if restored_col else []
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(texts)) for c in batch.columns[: len(kept)]), pa.array(scorer.scores(texts)), *more], schema.names)
                done += len(texts)

    new = {"restored": restored_col} if restored_col else {}
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, kept, strict=True)) | new)
