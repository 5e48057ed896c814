"""Splits texts into the pieces that byte-level BPE merges within, over whole batches of texts and without a regex.

Code points become symbols by a class table. A piece can start at a character or not according to a small automaton; each
symbol is a function from state to state, and functions compose associatively, so that the state before each character
comes from a blocked scan over a table of compositions. Equal pieces of a batch are encoded once, and a bounded cache
keeps them between batches; what shares a key with another piece is told apart from it by its characters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, WHITE, SPACE, QUOTE = range(6)
#: Symbols: the classes, with white space by what follows it, and a quote by whether a contraction of one or two letters follows.
S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_LAST, S_PREFIX, S_QUOTE1, S_QUOTE2 = range(8)
#: Symbols of a text's first characters are higher by this.
FIRST = 8
#: States, by what the open piece is: none, letters, numbers, others, a space that joins what follows, white space, a contraction that lacks one or two letters.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_PREFIX, IN_WHITE, LACKS1, LACKS2 = range(8)
#: White space as Unicode has it.
WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after a quote that make a contraction.
ONE_LETTER, TWO_LETTERS = ["s", "t", "m", "d"], ["re", "ve", "ll"]
CHUNK_CHARS = 500_000


#: Code points that Python's tables don't know are asked about in runs of so many; only of runs that aren't one piece each is asked about.
ASKED = 64


@cache
def classes() -> np.ndarray:
    """The class of each code point by Python's tables, which may be older than a library's."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_POINTS] = WHITE
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def classes_by(starts: Callable[[str], np.ndarray]) -> np.ndarray:
    """The class of each code point, as a library has it. starts: where the library's pieces of a text start. What Python's tables have no class for
    is a letter if it joins a letter before it, and a number if it joins a number."""
    unknown = np.array([i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cn"], np.uint32)
    as_text = lambda points: points.astype("<u4").tobytes().decode("utf-32-le")
    rows = [np.append([10, 35], unknown[i : i + ASKED]) for i in range(0, len(unknown), ASKED)]  # a line feed, a sign, and so many
    own = np.concatenate(rows)
    begins = np.bincount(starts(as_text(own)), minlength=len(own))
    first = np.cumsum([0, *map(len, rows[:-1])])
    mixed = np.add.reduceat(begins, first) != 2
    asked = np.concatenate([r[2:] for r, m in zip(rows, mixed.tolist(), strict=True) if m] or [np.zeros(0, np.uint32)])
    out = classes().copy()
    for sign, kind in (("a", LETTER), ("1", NUMBER)):
        own = np.full(3 * len(asked), ord(sign), np.uint32)
        own[::3], own[2::3] = 10, asked
        begins = np.bincount(starts(as_text(own)), minlength=len(own))
        out[asked[begins[2::3] == 0]] = kind
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this symbol."""
    if symbol >= FIRST:
        return step(NONE, symbol - FIRST)[0], True
    if state in (LACKS1, LACKS2):
        return {LACKS1: NONE, LACKS2: LACKS1}[state], False
    if symbol == S_RUN:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LAST:
        return NONE, True
    if symbol == S_PREFIX:
        return IN_PREFIX, True
    if symbol in (S_QUOTE1, S_QUOTE2) and state not in (IN_OTHERS, IN_PREFIX):
        return (LACKS1 if symbol == S_QUOTE1 else LACKS2), True
    kind = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return kind, state not in (kind, IN_PREFIX)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next state and start by (state, symbol); code of each symbol's function; composition by (first, then); result of each function by state."""
    n = 2 * FIRST
    grid = [[step(s, a) for a in range(n)] for s in range(8)]
    nxt, starts = np.array([[x[0] for x in r] for r in grid]), np.array([[x[1] for x in r] for r in grid])
    found = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for a in range(n):
        if (f := tuple(int(x) for x in nxt[:, a])) not in found:
            found[f] = len(order)
            order.append(f)
    symbols = np.array([found[tuple(int(x) for x in nxt[:, a])] for a in range(n)])
    generators = list(dict.fromkeys(order))
    at = 0
    while at < len(order):
        for g in generators:
            if (f := tuple(g[x] for x in order[at])) not in found:
                found[f] = len(order)
                order.append(f)
        at += 1
    compose = np.array([[found[tuple(g[x] for x in f)] for g in order] for f in order])
    return nxt.ravel(), starts.ravel(), symbols, compose, np.array(order)


def scan(codes: np.ndarray, width: int = 64) -> np.ndarray:
    """For each function, the composition of all before it."""
    compose = tables()[3]
    m = len(compose)
    flat = compose.ravel()
    if len(codes) <= width:
        out, acc = np.zeros(len(codes), np.int64), 0
        for i, c in enumerate(codes):
            out[i] = acc
            acc = compose[acc, c]
        return out
    rows = -(-len(codes) // width)
    grid = np.zeros(rows * width, np.int64)
    grid[: len(codes)] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    acc = grid[0]
    for w in range(1, width):
        acc = flat[acc * m + grid[w]]
    acc = scan(acc, width)
    out = np.empty_like(grid)
    for w in range(width):
        out[w] = acc
        acc = flat[acc * m + grid[w]]
    return out.T.reshape(-1)[: len(codes)]


def states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol: functions of blocks are composed and scanned, then each block is run from its state."""
    nxt, _, codes, compose, results = tables()
    m, flat, n = len(compose), compose.ravel(), 2 * FIRST
    rows = -(-len(symbols) // width)
    grid = np.full(rows * width, S_RUN, np.int64)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    acc = codes[grid[0]]
    for w in range(1, width):
        acc = flat[acc * m + codes[grid[w]]]
    state = results[scan(acc), NONE]
    out = np.empty((width, rows), np.uint8)
    for w in range(width):
        out[w] = state
        state = nxt[state * n + grid[w]]
    return out.T.reshape(-1)[: len(symbols)]


def starts(points: np.ndarray, firsts: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Where pieces start. points: code points of texts without a gap; firsts: where the non-empty texts start; kinds: the class of each code point."""
    kind = (classes() if kinds is None else kinds)[points]
    white = (kind == WHITE) | (kind == SPACE)
    ends = np.zeros(len(points), bool)  # the last characters of texts
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    before_black = np.zeros(len(points), bool)  # not white space and not the end follows
    before_black[:-1] = ~white[1:]
    before_black &= ~ends
    symbols = np.array([S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_RUN, S_OTHER])[kind]
    symbols[white & before_black] = S_LAST
    symbols[(kind == SPACE) & before_black] = S_PREFIX
    quotes = np.flatnonzero((kind == QUOTE) & ~ends)
    if len(quotes):
        padded = np.append(points, [0, 0]).astype(np.int64)
        one, two = padded[quotes + 1], padded[quotes + 2]
        two = np.where(ends[quotes + 1], 0, two)
        symbols[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = S_QUOTE1
        symbols[quotes[np.isin(one << 32 | two, [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])]] = S_QUOTE2
    symbols[firsts] += FIRST
    return np.flatnonzero(tables()[1][states(symbols).astype(np.int64) * (2 * FIRST) + symbols])


@cache
def powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def keys(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit key of each piece: a polynomial of its code points, mixed with its length."""
    size = np.diff(np.append(begin, len(points)))
    most = 1 << int(size.max()).bit_length()
    at = np.arange(len(points)) - np.repeat(begin, size)
    out = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * powers(max(most, 64))[at], begin)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32)) ^ (size.astype(np.uint64) << np.uint64(40))


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Lists of texts, null as empty, of about CHUNK_CHARS characters; a longer text is alone in its list."""
    out, n = [], 0
    for t in texts:
        t = t or ""
        if out and n + len(t) > CHUNK_CHARS:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def alike(points: np.ndarray, begin: np.ndarray, size: np.ndarray, others: np.ndarray, other_begin: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each piece (``begin`` and ``size`` in ``points``, one after another) has the characters of another one in ``others``."""
    at = np.arange(len(points)) + np.repeat(other_begin - begin, size)
    differs = others[np.minimum(at, len(others) - 1)] != points
    return (size == other_size) & ~np.logical_or.reduceat(differs, begin)


def appended(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store``, larger if it must be, with ``more`` after its first ``used`` values."""
    while used + len(more) > len(store):
        store = np.concatenate([store, np.zeros_like(store)])
    store[used : used + len(more)] = more
    return store


class PieceEncoder:
    """Encodes texts piece by piece. merge: gets distinct pieces, gives all their ids in one array, and how many each has. kinds: the class of
    each code point; Python's without it.

    Of the pieces seen, ``most`` are kept with their ids in arrays sorted by key; beyond that the cache starts anew. Keys only
    say where to look: each piece is compared, character by character, with the one whose ids it would get, and is merged by
    itself if they differ.
    """

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000, kinds: np.ndarray | None = None):
        self.merge, self.most, self.kinds = merge, most, kinds
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.text_at, self.text_size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.points, self.points_used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, new_keys: np.ndarray, pieces: list[str]) -> None:
        ids, size = self.merge(pieces)
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        new = [self.used + np.cumsum(size) - size, size, self.points_used + np.cumsum(text_size) - text_size, text_size]
        self.ids, self.used = appended(self.ids, self.used, ids), self.used + len(ids)
        self.points, self.points_used = appended(self.points, self.points_used, points), self.points_used + len(points)
        order = np.argsort(both := np.concatenate([self.keys, new_keys]), kind="stable")
        self.keys = both[order]
        self.at, self.size, self.text_at, self.text_size = (np.concatenate(x)[order] for x in zip((self.at, self.size, self.text_at, self.text_size), new, strict=True))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cache, and which are there."""
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == wanted) if len(self.keys) else np.zeros(len(wanted), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin in it, with the end."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not lengths.sum():
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        begin = starts(points, bounds[:-1][lengths > 0], self.kinds)
        length = np.diff(np.append(begin, len(points)))
        distinct, first, which = np.unique(keys(points, begin), return_index=True, return_inverse=True)
        odd = ~alike(points, begin, length, points, begin[first][which], length[first][which])
        at, known = self.find(distinct)
        cut = lambda x: [joined[a : a + n] for a, n in zip(begin[x].tolist(), length[x].tolist(), strict=True)]
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > self.most:  # the cache starts anew, so all of this batch is new
                self.clear()
                new, known = np.arange(len(distinct)), np.zeros(len(distinct), bool)
            self.learn(distinct[new], cut(first[new]))
            at, _ = self.find(distinct)
        if known.any():
            old = np.flatnonzero(known)
            n = length[first[old]]
            to = np.cumsum(n) - n
            own = points[np.arange(n.sum()) + np.repeat(begin[first[old]] - to, n)]
            known[old] = ~alike(own, to, n, self.points, self.text_at[at[old]], self.text_size[at[old]])  # now: has another's key
            odd |= known[which]
        size, source, ids = self.size[at][which], self.at[at][which], self.ids
        if odd.any():
            pieces = cut(np.flatnonzero(odd))
            place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            more, n = self.merge(list(place))
            own = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
            size[odd], source[odd], ids = n[own], (len(ids) + np.cumsum(n) - n)[own], np.concatenate([ids, more])
        ends = np.cumsum(size)
        ids = ids[np.arange(ends[-1]) + np.repeat(source - (ends - size), size)]
        return ids, np.append(0, ends)[np.searchsorted(begin, bounds)]
