"""Phrase collocations from suffix automata over words.

A shard is a run of texts. Its generalised suffix automaton, over the words of all pieces of its texts and of bounded depth, has a
state for each class of word runs that end at the same places. Suffix links make a tree that is the tree of reversed runs, so
that states, links and the numbers of their end places come from grouping end places by the word before, level by level, and
joining a run with its suffix where both have as many ends. A walk over the states gives each run with its count; Spark sums the
counts of shards, scores runs by their weakest cut and drops those that a longer one explains, which it reaches by its link and
by the mirrored one. Longer runs than two words are counted in a second pass, over pieces cut where two words beside each other aren't
frequent: no frequent run crosses such a place. Which pairs are frequent is asked of a filter of bounded size that may say yes too often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, joined, written
from .near import mixed
from .pieces import keys

#: Bytes of text of a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Rows of a batch that goes back to Spark.
ROWS = 100_000
#: What ends a piece, and what ends a word within one.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Lower case, piece ends as line feeds, word ends as spaces.
PLAIN = bytes(10 if c in PIECE_ENDS else 32 if c in WORD_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Cells of the filter of frequent pairs, for each pair and at most (32 MB of bits, as it is broadcast), and of a block of it.
CELLS, MOST_CELLS, BLOCK = 16, 1 << 28, 1 << 16
#: Parts that a language's candidates are ranked in before its first ones are.
PARTS = 64


def words_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of all texts one after another; of each the number of its piece, and of its text."""
    raw = np.frombuffer("\n".join(t or "" for t in texts).encode().translate(PLAIN), np.uint8)
    black = (raw != 32) & (raw != 10)
    first = black.copy()
    first[1:] &= ~black[:-1]
    begin = np.flatnonzero(first)
    size = np.fromiter((len((t or "").encode()) + 1 for t in texts), np.int64, len(texts))
    piece = np.cumsum(raw == 10)[begin]
    text = np.searchsorted(np.cumsum(size), begin, side="right")
    place = np.cumsum(black)[begin] - 1
    offsets = np.append(place, black.sum()).astype(np.int32)
    own = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[black]))
    return own.dictionary_encode(), piece, text


@dataclass
class Automaton:
    """States by number, state 0 is the root of the first group. length: words of a state's longest run; link: the state of its longest
    suffix that has more ends (itself for roots); ends: how many places its runs end at; end: one of these places."""

    length: np.ndarray
    link: np.ndarray
    ends: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, piece: np.ndarray, group: np.ndarray, depth: int) -> Automaton:
        """Of runs of up to ``depth`` words within pieces; groups (numbers, the same for all words of a piece) have automata of their own."""
        n = len(words)
        at, node = np.arange(n), group.astype(np.int64)
        roots, first, node = np.unique(node, return_index=True, return_inverse=True)
        parts = [(np.zeros(len(roots), np.int64), np.arange(len(roots)), np.bincount(node, minlength=len(roots)), first)]
        before = 0
        base = int(words.max(initial=0)) + 1
        for k in range(1, depth + 1):
            inside = at >= k - 1
            inside[inside] = piece[at[inside] - (k - 1)] == piece[at[inside]]
            at, node = at[inside], node[inside]
            keys, where, own, ends = np.unique(node * base + words[at - (k - 1)], return_index=True, return_inverse=True, return_counts=True)
            parts.append((np.full(len(keys), k), before + keys // base, ends, at[where]))
            before += len(parts[-2][0])
            node = own
        length, link, ends, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        root = length == 0
        same = ~root & (ends == ends[link]) & ~root[link]  # a run whose suffix has no other ends is in that suffix's class
        longer = np.arange(len(length))
        longer[link[same]] = np.flatnonzero(same)  # at most one run is in a suffix's class
        for _ in range(depth):
            longer = longer[longer]
        state = longer == np.arange(len(length))
        shortest = link.copy()
        for _ in range(depth):  # to the suffix before a state's shortest run
            up = same & (shortest != link[shortest])
            move = up & (ends[shortest] == ends) & ~root[shortest]
            shortest = np.where(move, link[shortest], shortest)
        number = np.cumsum(state) - 1
        return cls(length[state], number[longer[shortest[state]]], ends[state], end[state])

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All runs: their words, their last places, and how often they occur. A state has runs of all lengths above its link's."""
        above = np.where(self.link == np.arange(len(self.link)), -1, self.length[self.link])
        for k in range(int(self.length.max(initial=-1)) + 1):
            own = (above < k) & (k <= self.length)
            yield k, self.end[own], self.ends[own]


def hashed(words: pa.StringArray) -> np.ndarray:
    """A number of 64 bits for each word; words aren't empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return keys(np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0])


def cells_of(langs: pa.StringArray, left: np.ndarray, right: np.ndarray, cells: int) -> np.ndarray:
    """The filter's cell of each pair of words, given by their hashes."""
    of = np.fromiter((zlib.crc32(x.encode()) for x in langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))
    lang = of[langs.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(len(left), np.uint64)
    return (mixed(mixed(left ^ mixed(lang + np.uint64(1))) + right) & np.uint64(cells - 1)).astype(np.int64)


def pair_filter(pairs: DataFrame, most_cells: int) -> np.ndarray:
    """Bits of the cells that pairs (lang, phrase) have. What comes to the driver has ``most_cells`` bits at most, whatever the number of pairs."""
    cells = min(most_cells, 1 << max(16, (CELLS * pairs.count()).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.unique(cells_of(batch.column(0).dictionary_encode(), hashed(batch.column(1)), hashed(batch.column(2)), cells))
            start = np.flatnonzero(np.diff(hit // BLOCK, prepend=-1))
            parts = np.split((hit % BLOCK).astype(np.uint16), start[1:])
            yield pa.RecordBatch.from_arrays([pa.array(hit[start] // BLOCK, pa.int32()), pa.array([x.tobytes() for x in parts] if len(start) else [], pa.binary())], ["block", "hits"])

    def total(table: pa.Table) -> pa.Table:
        own = np.zeros(BLOCK, bool)
        for x in table.column("hits"):
            own[np.frombuffer(x.as_buffer(), np.uint16)] = True
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bits = np.zeros(cells // 8, np.uint8)
    words = pairs.select("lang", first_words(F.col("phrase"), F.lit(1)).alias("l"), first_words(F.col("phrase"), F.lit(-1)).alias("r"))
    for row in words.mapInArrow(send, "block int, hits binary").groupBy("block").applyInArrow(total, "block int, bits binary").collect():
        bits[row["block"] * (BLOCK // 8) :][: BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def counted(docs: DataFrame, lengths: range, lang_col: str, text_col: str, bits: np.ndarray | None = None) -> DataFrame:
    """Of each shard: lang, k, phrase, f, for runs of so many words; k = 0 has all words. With a filter's bits, pieces are cut where a pair isn't in it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SHARD_BYTES, side="right")))
            yield batch.slice(a, b - a)
            a = b

    def cut(piece: np.ndarray, ids: np.ndarray, langs: pa.DictionaryArray, words: pa.StringArray) -> np.ndarray:
        own, h = shared.value, hashed(words)[ids]
        cell = cells_of(pa.DictionaryArray.from_arrays(langs.indices[1:], langs.dictionary), h[:-1], h[1:], 8 * len(own))
        there = (own[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return np.append(0, np.cumsum((piece[1:] != piece[:-1]) | ~there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(batch):
                langs = shard.column(0).dictionary_encode()
                words, piece, text = words_of(shard.column(1).to_pylist())
                ids = words.indices.to_numpy(zero_copy_only=False)
                group = langs.indices.to_numpy(zero_copy_only=False)[text]
                if shared and len(ids):
                    piece = cut(piece, ids, pa.DictionaryArray.from_arrays(pa.array(group), langs.dictionary), words.dictionary)
                for k, end, ends in Automaton.of(ids, piece, group, lengths[-1]).runs():
                    for i in range(0, len(end) if k in lengths else 0, ROWS):
                        e = end[i : i + ROWS]
                        own = [words.dictionary.take(pa.array(ids[e - j])) for j in range(k - 1, -1, -1)]
                        phrase = pc.binary_join_element_wise(*own, " ") if own else pa.array([""] * len(e))
                        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(group[e])), pa.array(np.full(len(e), k, np.int32)), phrase, pa.array(ends[i : i + ROWS].astype(np.int64))], ["lang", "k", "phrase", "f"])

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "lang string, k int, phrase string, f long")


def summed(shards: DataFrame, least: int) -> DataFrame:
    """Counts over all shards, of runs that occur ``least`` times or more (and of k = 0). A shard has each run once, so that another sum before the
    shuffle would hold much and save little."""
    sums = shards.repartition("lang", "k", "phrase").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | (F.col("k") == 0))


def first_words(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, most: int = 2000, covered: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Of each language (null: und) its ``most`` best phrases of 2 to ``most_words`` words that occur ``least`` times or more: lang, rank (from
    1), phrase, a (its count), l and r (counts of the parts of its weakest cut), n (all words of the language), score: floor(10^6 a a / (l r)).

    Texts are lower-cased (A-Z only); phrases don't reach over piece ends. A phrase is dropped if a longer candidate that
    contains it occurs ``covered`` percent as often or more. Ranks go by score and count, both descending, then by the bytes of the
    phrase, so that there are no ties. Null and empty texts have no words; repeated rows count each; an empty table gives no rows.
    Other columns aren't read. Counts are summed by shard before the shuffle; words that many phrases have are looked up by broadcast.
    """
    frugal(docs.sparkSession)
    counts = written(summed(counted(docs, range(3), lang_col, text_col), least), "phrase-counts")
    if most_words > 2:
        bits = pair_filter(counts.where("k = 2"), MOST_CELLS)
        more = written(summed(counted(docs, range(3, most_words + 1), lang_col, text_col, bits), least), "phrase-counts")
        counts = counts.unionByName(more)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    everything = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.where("k > 0").select(F.struct("lang", "phrase").alias("key"), "f")
    hot = known.where(F.col("f") * 1000 > everything)  # fewer than 1000 of each length

    found = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    # Runs one word shorter are enough: what a still longer one holds is also in a run between them, which is at least as frequent.
    link, mirrored = first_words(F.col("phrase"), 1 - F.col("k")), first_words(F.col("phrase"), F.col("k") - 1)
    inner = found.where("k > 2").select("lang", "a", F.explode(F.array(link, mirrored)).alias("phrase"))
    best = inner.groupBy("lang", "phrase").agg(F.max("a").alias("best"))
    free = found.join(best, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("best") < covered * F.col("a"), F.lit(True))).drop("best")

    cuts = free.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    for part, count in ((first_words(F.col("phrase"), F.col("cut")), "l"), (first_words(F.col("phrase"), F.col("cut") - F.col("k")), "r")):
        wanted = cuts.withColumn("key", F.struct(F.col("lang"), part.alias("phrase")))
        cuts = joined(wanted, known.withColumnRenamed("f", count), "key", hot.withColumnRenamed("f", count)).drop("key")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)")
    scored = cuts.withColumns({f"{c}_": whole(c) for c in "alr"}).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = weakest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    top = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
