"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The field's tags begin or go on with one of KINDS, or are outside. Features are of a word's shape and marks, at its place and
its neighbours'; weights of features and of neighbouring tags are learned from a small table of tagged words by the gradient of
its likelihood. Decoding is Viterbi over whole texts, in numpy batches. Where a window of words decides by itself that its middle
is outside, whatever is around (as in plain prose), a text may be cut without a change of its best tags; what is between such places is decoded
side by side. What the field finds must pass the checks of its kind, and counts where no pattern has found anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WHITE, with_text
from .pieces import chunks

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O"] + [f"{x}-{k}" for k in KINDS for x in "BI"]
#: A window has this many words on each side of its middle, and sees one more for their features.
SIDE = 2
#: Classes of words that windows can have: 2 * SIDE + 3 of them make a 64-bit key.
CLASS_BITS = 9
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9.])[0-9.]*[0-9]\.[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of what the fixed patterns find, in time proportional to the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, last := m.end()))
        at = text.find("@", max(at + 1, last))
    if "." in text:
        for m in NUMBERS.finditer(text):
            parts, place, i = m.group().split("."), [], 0
            if len(parts) < 4:
                continue
            end = m.start()
            for p in parts:
                place.append(end)
                end += len(p) + 1
            while i + 3 < len(parts):
                if all(parts[i : i + 4]):
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4]):
                        out.append((place[i], 1, place[i + 3] + len(parts[i + 3])))
                    i += 4
                else:
                    i += 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@lru_cache(200_000)
def features(word: str) -> tuple[str, ...]:
    """Names of a word's features: its shape, with letters as one and digits to four, and marks that it has."""
    shape = re.sub(r"[A-Z]+", "X", re.sub(r"[a-z\u0080-\U0010ffff]+", "x", word))
    shape = re.sub(r"[0-9]{5,}", "9", re.sub(r"(?<![0-9])[0-9]{1,4}(?![0-9])", lambda m: "d" * len(m.group()), shape))
    n = len(only_digits(word))
    out = [f"shape={shape[:24]}", f"digits={min(n, 8) if n < 9 else 9 + (n > 11) + (n > 19)}"]
    out += [f"has{c}" for c in "@.-()+[]:/,$%" if c in word]
    if (bare := word.strip("()[]{}<>.,;:").lower()) in ("at", "dot"):
        out.append(f"{bare}{int(word[:1] in '([{<')}")
    if n and n == len(word):
        out.append("all digits")
    if not n:
        out.append("no digits")
    return tuple(out)


class Field:
    """Weights of the conditional random field. Words with the same known features are of one class."""

    def __init__(self, names: dict[str, int], seen: np.ndarray, moves: np.ndarray):
        self.names, self.seen, self.moves = names, seen, moves
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.of_features: dict[tuple[int, ...], int] = {}
        self.rows = np.zeros((0, 3, len(TAGS)))
        self.windows, self.decided = np.zeros(0, np.uint64), np.zeros(0, bool)

    def classes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known = {}
        if len(self.of_features) > 20_000 or len(self.windows) > 2_000_000:
            self.clear()
        known, rows = self.known, []
        for w in set(words).difference(known):
            own = tuple(self.names[f] for f in features(w) if f in self.names)
            if (c := self.of_features.get(own)) is None:
                c = self.of_features[own] = len(self.of_features)
                rows.append(self.seen[list(own)].sum(0))
            known[w] = c
        if rows:
            self.rows = np.concatenate([self.rows, np.stack(rows)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word's tags from its own features: as it is, for the word after it, for the word before it."""
        classes = self.classes(words)
        return self.rows[classes]

    def decides(self, keys: np.ndarray) -> np.ndarray:
        """Whether a window's middle is outside on the best path between any tags of the window's ends."""
        of = [(keys >> np.uint64(CLASS_BITS * i) & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64) for i in range(2 * SIDE + 2, -1, -1)]
        moves = self.moves[1:]
        best = np.broadcast_to(np.where(np.eye(len(TAGS), dtype=bool), 0.0, -1e9), (len(keys), len(TAGS), len(TAGS)))  # first tag, tag
        middle = None
        for p in range(1, 2 * SIDE + 1):
            e = self.rows[of[p + 1], 0] + self.rows[of[p], 1] + self.rows[of[p + 2], 2] if p < 2 * SIDE else 0.0  # the last tag is given
            forward = lambda x: np.stack([(x + moves[:, k]).max(2) for k in range(len(TAGS))], 2) + (e[:, None] if p < 2 * SIDE else 0.0)  # noqa: B023, E731
            best, middle = forward(best), [forward(x) for x in middle] if middle else None
            if p == SIDE:
                outside = np.arange(len(TAGS)) == 0
                middle = [np.where(outside, best, -1e9), np.where(outside, -1e9, best)]
        return (middle[0] - middle[1]).min((1, 2)) > 1e-6

    def outside(self, classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words that are outside on the best path of their text, as the words around them decide."""
        out, width = np.zeros(len(classes), bool), 2 * SIDE + 3
        if len(classes) < width:
            return out
        n = len(classes) - width + 1
        keys, fine = np.zeros(n, np.uint64), doc[:n] == doc[width - 1 :]
        for i in range(width):
            keys = keys << np.uint64(CLASS_BITS) | classes[i : n + i].astype(np.uint64)
            fine &= classes[i : n + i] < 1 << CLASS_BITS
        at = np.flatnonzero(fine)
        distinct, which = np.unique(keys[at], return_inverse=True)
        place = np.minimum(np.searchsorted(self.windows, distinct), max(0, len(self.windows) - 1))
        new = distinct[self.windows[place] != distinct] if len(self.windows) else distinct
        for i in range(0, len(new), 4096):
            self.decided = np.append(self.decided, self.decides(new[i : i + 4096]))
        order = np.argsort(both := np.append(self.windows, new), kind="stable")
        self.windows, self.decided = both[order], self.decided[order]
        out[at + SIDE + 1] = self.decided[np.searchsorted(self.windows, distinct)][which]
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of sequences of equal length: scores is (sequences, words, tags)."""
        n, size, _ = scores.shape
        best, back = scores[:, 0] + self.moves[0], np.zeros(scores.shape, np.int8)
        for t in range(1, size):
            step = best[:, :, None] + self.moves[None, 1:]
            back[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
        out = np.zeros((n, size), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(size - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def decode_all(self, scores: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, after: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
        """The best tags of sequences of any lengths, given one after another: scores is (words, tags), firsts where they begin;
        after and before: which sequences follow, or come before, a word outside of the same text."""
        order = np.argsort(-lengths, kind="stable")
        firsts, lengths = firsts[order], lengths[order]
        longer = np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()  # sequences that have a word t
        begin = self.moves[0] if after is None else np.where(after[order, None], self.moves[1], self.moves[0])
        best, back, out = scores[firsts] + begin, np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int8)
        for t in range(1, len(longer)):
            at = firsts[: longer[t]] + t
            step = best[: longer[t], :, None] + self.moves[None, 1:]
            back[at] = step.argmax(1)
            best[: longer[t]] = step.max(1) + scores[at]
        if before is not None:
            best = best + np.where(before[order, None], self.moves[1:, 0], 0.0)
        out[firsts + lengths - 1] = best.argmax(1)
        for t in range(len(longer) - 1, 0, -1):
            at = firsts[: longer[t]] + t
            out[at - 1] = back[at, out[at]]
        return out


def allowed() -> np.ndarray:
    """0 for moves between tags that can be, else a large negative; first row: from the start."""
    out = np.zeros((len(TAGS) + 1, len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            out[:, j] = -1e4
            for i, before in enumerate(TAGS):
                if before != "O" and before[2:] == tag[2:]:
                    out[i + 1, j] = 0
    return out


def placed(own: np.ndarray) -> np.ndarray:
    """Sums of words' emissions in sequences (sequences, words, 3, tags): their own and those of the words around."""
    out = own[:, :, 0].copy()
    out[:, 1:] += own[:, :-1, 1]
    out[:, :-1] += own[:, 1:, 2]
    return out


def train(rows: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.1, decay: float = 3e-4) -> Field:
    """Weights of most likelihood, less a penalty on squares, by Adam; sequences of words and of their tags."""
    names: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                names.setdefault(f, len(names))
    size, k = max(len(w) for w, _ in rows), len(TAGS)
    x, y, mask = np.zeros((len(rows), size, len(names)), np.float32), np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), bool)
    for i, (words, tags) in enumerate(rows):
        for t, (w, tag) in enumerate(zip(words, tags, strict=True)):
            x[i, t, [names[f] for f in features(w)]] = 1
            y[i, t], mask[i, t] = TAGS.index(tag), True
    seen, moves, fixed = np.zeros((len(names), 3, k)), np.zeros((k + 1, k)), allowed()
    params, m, s = [seen, moves], [0.0, 0.0], [0.0, 0.0]
    hot = np.eye(k)[y] * mask[:, :, None]
    for step in range(1, epochs + 1):
        e, tr = placed(np.einsum("ntf,fpk->ntpk", x, seen, optimize=True)), moves + fixed
        up = [e[:, 0] + tr[0]]
        for t in range(1, size):
            z = up[-1][:, :, None] + tr[None, 1:]
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[:, t]
            up.append(np.where(mask[:, t, None], new, up[-1]))
        down, total = np.zeros((len(rows), k)), up[-1].max(1) + np.log(np.exp(up[-1] - up[-1].max(1)[:, None]).sum(1))
        de, dm = np.zeros_like(e), np.zeros_like(moves)
        for t in range(size - 1, -1, -1):
            de[:, t] = np.exp(up[t] + down - total[:, None]) * mask[:, t, None]
            if t:
                after = e[:, t] + down
                pair = np.exp(up[t - 1][:, :, None] + tr[None, 1:] + after[:, None] - total[:, None, None]) * mask[:, t, None, None]
                dm[1:] += pair.sum(0) - np.einsum("ni,nj->ij", hot[:, t - 1] * mask[:, t, None], hot[:, t])
                z = tr[None, 1:] + after[:, None]
                top = z.max(2)
                down = np.where(mask[:, t, None], top + np.log(np.exp(z - top[:, :, None]).sum(2)), down)
        dm[0] = (de[:, 0] - hot[:, 0]).sum(0)
        de -= hot
        ds = np.stack([np.einsum("ntf,ntk->fk", x, de, optimize=True), np.einsum("ntf,ntk->fk", x[:, :-1], de[:, 1:], optimize=True), np.einsum("ntf,ntk->fk", x[:, 1:], de[:, :-1], optimize=True)], 1)
        for i, g in enumerate((ds, dm)):
            g = g / len(rows) + decay * params[i]
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return Field(names, seen, moves + fixed)


def examples(n: int = 480, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sequences of invented words with entities in usual and in unusual forms, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick, digits = lambda x: x[rng.integers(len(x))], lambda k: "".join(map(str, rng.integers(0, 10, k)))
    part = ["an", "the", "lo", "ri", "ver", "ent", "sa", "mo", "qui", "ä", "é", "tion", "ing", "er", "st"]
    word = lambda: "".join(pick(part) for _ in range(rng.integers(1, 5)))
    plain = lambda: pick([word, word, word, lambda: word().title(), lambda: word() + pick([".", ",", ";", "!!", "%%%"]), lambda: "|"])()

    def card() -> list[str]:
        body = pick(["4", "5", "37", "9"]) + digits(int(rng.integers(10, 15)))
        whole = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick([lambda: [whole], lambda: [whole[i : i + 4] for i in range(0, len(whole), 4)], lambda: ["-".join(whole[i : i + 4] for i in range(0, len(whole), 4))]])()

    def email() -> list[str]:
        a, b, c = word(), word(), pick(["com", "org", "net", "de"])
        return pick([
            lambda: [f"{a}.{digits(2)}@{b}.example.{c}"], lambda: [f"{a}@{b}.{c}"], lambda: [a, "[at]", b, "[dot]", c], lambda: [a, "(at)", b, "(dot)", c], lambda: [f"{a}[at]{b}[dot]{c}"], lambda: [f"{a}(at){b}.{c}"],
            lambda: [a, "@", f"{b}.{c}"], lambda: [f"{a}.{digits(2)}", "[at]", f"{b}.{c}"],
        ])()

    phone = lambda: pick([lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", digits(3), digits(4), digits(3)], lambda: [f"{digits(3)}.{digits(3)}.{digits(4)}"]])()
    ip = lambda: [".".join(str(rng.integers(0, 256)) for _ in range(4)) + pick(["", ",", "."])]
    none = lambda: pick([
        lambda: [digits(4)], lambda: [digits(int(rng.integers(1, 8)))], lambda: [f"{digits(2)}.{digits(2)}.{digits(4)}"], lambda: [f"20{digits(2)}-{digits(2)}-{digits(2)}"], lambda: [f"${digits(3)}.{digits(2)}"], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}"],
        lambda: ["token", "=", f'"{"".join(pick(list("0123456789abcdef")) for _ in range(32))}"'], lambda: [f"({word()}"] + [f"{word()})"], lambda: [f"({digits(4)})"], lambda: [f"[{digits(1)}]"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [f"{digits(3)}-{digits(3)}"], lambda: [f"@{word()}"], lambda: [digits(2), digits(3)],
    ])()
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.integers(1, 4)):
            for w in (plain() for _ in range(rng.integers(1, 5))):
                words.append(w)
                tags.append("O")
            kind = pick([*KINDS, None, None, None])
            own = makers[kind]() if kind else none()
            words += own
            tags += [f"{'I' if i else 'B'}-{kind}" for i in range(len(own))] if kind else ["O"] * len(own)
        words.append(plain())
        tags.append("O")
        out.append((words, tags))
    return out


def examples_table(spark: SparkSession) -> DataFrame:
    """``examples`` as a table: words, tags."""
    return spark.createDataFrame(examples(), "words array<string>, tags array<string>")


#: What a word is, by code point; all above 127 count as letters.
BLACK = np.ones(129, bool)
BLACK[[ord(c) for c in WHITE]] = False
#: Letters of a kind, and digits, as one: words that are alike then have the same features, but for "at" and "dot".
ALIKE = np.arange(129, dtype=np.uint8)
ALIKE[97:123], ALIKE[128], ALIKE[65:91], ALIKE[48:58] = ord("x"), ord("x"), ord("X"), ord("0")
SHORT = re.compile(r"[^A-Za-z]*[A-Za-z]{2,3}[^A-Za-z]*")


def alike(joined: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Words by what their features depend on."""
    mapped = ALIKE[points].tobytes().decode("ascii")
    words = [mapped[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    short = {w for w in set(words) if SHORT.fullmatch(w)}
    return [joined[a:b] if w in short else w for w, a, b in zip(words, start.tolist(), end.tolist(), strict=True)] if short else words


def valid(kind: int, text: str) -> bool:
    """Checks of what the field found."""
    d = only_digits(text)
    if kind == 0:
        plain = re.sub(r"\s+", " ", text)
        plain = re.sub(r" ?[\[(](dot)[\])] ?", ".", re.sub(r" ?(?:[\[(]at[\])]|@) ?", "@", plain, flags=re.I), flags=re.I)
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9\s-]+", text) is not None
    return 10 <= len(d) <= 15 and re.fullmatch(r"\+?[0-9][0-9\s().-]+|\([0-9]{2,4}\)[0-9\s.-]+", text) is not None and (re.search(r"[().-]", text) is not None or text[0] == "+")


def found_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the field decodes in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    joined = "\n".join(texts)
    if not joined:
        return out
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    black = BLACK[points]
    edge = np.diff(black.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return out
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    doc = np.searchsorted(begin, start, "right") - 1
    classes = field.classes(alike(joined, points, start, end))
    sure = field.outside(classes, doc)
    at = np.flatnonzero(~sure)
    inner = np.append(False, doc[1:] == doc[:-1])  # words that follow one of the same text
    new = np.flatnonzero(np.append(True, np.diff(at) > 1) | ~inner[at])
    scores = field.rows[classes[at], 0]
    later = np.flatnonzero(inner[at])
    scores[later] += field.rows[classes[at[later] - 1], 1]
    earlier = np.flatnonzero(np.append(inner, False)[at + 1])
    scores[earlier] += field.rows[classes[at[earlier] + 1], 2]
    last = np.append(new[1:], len(at)) - 1
    tags = field.decode_all(scores, new, last - new + 1, inner[at[new]], np.append(inner, False)[at[last] + 1])
    for i in np.flatnonzero(tags % 2 == 1).tolist():
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and at[j] == at[j - 1] + 1 and inner[at[j]]:
            j += 1
        a, b, kind = int(start[at[i]]), int(end[at[j - 1]]), (int(tags[i]) - 1) // 2
        while b > a and joined[b - 1] in ".,;:!?\"'|>":
            b -= 1
        while a < b and joined[a] in ".,;:\"'|<":
            a += 1
        if valid(kind, joined[a:b]):
            d = int(doc[at[i]])
            out[d].append((a - int(begin[d]), kind, b - int(begin[d])))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find(df: DataFrame, tagged: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None, redacted_col: str | None = None) -> DataFrame:
    """Per row: ``id_col`` (or the columns ``kept``), spans: array of (kind, start, end, base) by start and kind, in code points, end
    exclusive; and in ``redacted_col``, if it is named, the text with each span, or spans that overlap, as [KIND].

    A null text is empty and has no spans; it stays null where it is redacted. Rows count each, whatever their ids; an
    empty table gives no rows; ``kept`` may have any names but "spans". tagged: a small table of words and tags (arrays), by
    default the one of ``examples``.
    """
    kept = kept or [id_col]
    rows = [(list(r["words"]), list(r["tags"])) for r in (tagged if tagged is not None else examples_table(df.sparkSession)).collect()]
    shared = df.sparkSession.sparkContext.broadcast(train(rows))
    names = [f"c{i}" for i in range(len(kept))]
    more = [T.StructField("spans", SPANS)] + ([T.StructField("redacted", T.StringType())] if redacted_col else [])
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, kept, strict=True)] + more)
    from pyspark.sql.pandas.types import to_arrow_type

    span_type = to_arrow_type(SPANS)

    source, at = with_text(df, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            done, column = 0, batch.column(at)
            for texts in chunks(column.to_pylist()):
                spans, hidden = [], []
                for i, (text, extra) in enumerate(zip(texts, found_spans(texts, field), strict=True)):
                    base = base_spans(text)
                    own = [(*x, True) for x in base] + [(*x, False) for x in extra if not any(x[0] < e and s < x[2] for s, _, e in base)]
                    own.sort()
                    spans.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in own])
                    if redacted_col:
                        hidden.append(redacted(text, own) if column[done + i].is_valid else None)
                last = [pa.array(hidden, pa.string())] if redacted_col else []
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(texts)) for c in batch.columns[: len(kept)]), pa.array(spans, span_type), *last], schema.names)
                done += len(texts)

    found = source.mapInArrow(run, schema)
    return found.withColumnsRenamed(dict(zip(names, kept, strict=True)) | ({"redacted": redacted_col} if redacted_col else {}))


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with spans, sorted, as their kind's name; of spans that overlap the first counts."""
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text
