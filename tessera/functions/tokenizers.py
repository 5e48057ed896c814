"""Tokenizers as column functions: a native one, and an Arrow adaptor for files of the tokenizers library."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BOS, EOS, PAD, WHITE_CHARS, char_ids


@dataclass(frozen=True)
class Tokenizer:
    """segments: array<string> to array<array<int>>, each string by itself; special: ids of the template's tokens by their text."""

    segments: Callable[[Column], Column]
    special: dict[str, int | None]

    def ids(self, text: Column) -> Column:
        return self.segments(F.array(text))[0]


CHAR = Tokenizer(lambda parts: F.transform(parts, char_ids), {BOS: 0x110000, EOS: 0x110001, PAD: 0x110002})


@lru_cache(4)
def loaded(path: str):
    """One of each worker and file."""
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


#: What ``Units`` encodes by itself: white space and all up to the next.
UNIT = re.compile(f"[{WHITE_CHARS}]*[^{WHITE_CHARS}]+")
#: Bytes of units that a worker remembers, about, with so many for each beside its characters; units that the library gets together.
REMEMBERED, BESIDE, TOGETHER = 128_000_000, 240, 512


class Units:
    """Ids of texts without outer white space, by a file of the tokenizers library whose pieces never go from a character to white space after it: byte-level
    BPE by the library's own splitter. So a text's ids are those of its units, and joined texts have ``feed`` more for each line feed between them.
    Ids of units are remembered."""

    def __init__(self, own):
        self.own, self.known, self.size = own, {}, 0
        self.numbers = list(range(own.get_vocab_size() + 1))  # one object of each id, whatever the number of units
        self.feed = len(own.encode("\n", add_special_tokens=False))

    def learn(self, units: list[str]) -> None:
        for i in range(0, len(units), TOGETHER):
            some = units[i : i + TOGETHER]
            found, ids = self.own.encode(some, is_pretokenized=True, add_special_tokens=False), [[] for _ in some]
            for k, x in zip(found.word_ids, found.ids, strict=True):
                ids[k].append(self.numbers[x] if x < len(self.numbers) else x)
            self.known.update(zip(some, map(tuple, ids), strict=True))
        self.size += sum(map(len, units)) + BESIDE * len(units)

    def ids(self, text: str) -> list[int]:
        """Of one of the texts that were counted last."""
        return list(chain.from_iterable(map(self.known.__getitem__, UNIT.findall(text))))

    def counts(self, texts: list[str]) -> list[int]:
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        parts = [UNIT.findall(t) for t in texts]
        self.learn(list({u for p in parts for u in p if u not in self.known}))
        return [sum(map(len, map(self.known.__getitem__, p))) for p in parts]


@lru_cache(4)
def units(path: str) -> Units | None:
    """One of each worker and file; None if the file's tokens aren't those of units."""
    own = loaded(path)
    file = json.loads(own.to_str())
    split, model = file["pre_tokenizer"] or {}, file["model"]
    plain = all(file[c] is None for c in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
    split_by_white = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(WHITE_CHARS) & set(t["content"])) for t in file["added_tokens"])
    return Units(own) if plain and split_by_white and apart else None


def library(path: str, bos: str = BOS, eos: str = EOS, pad: str = PAD) -> Tokenizer:
    """A tokenizer file that each machine has. Strings of a batch are encoded together, without special tokens; an empty one has no ids."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = loaded(path)
        for batch in batches:
            rows = [[] if x is None else ["" if s is None else s for s in x] for x in batch]
            done = iter(own.encode_batch([s for r in rows for s in r], add_special_tokens=False))
            yield pd.Series([None if x is None else [next(done).ids for _ in r] for x, r in zip(batch, rows, strict=True)])

    own = loaded(path)
    return Tokenizer(encode, {BOS: own.token_to_id(bos), EOS: own.token_to_id(eos), PAD: own.token_to_id(pad)})


def checked(tokenizer: Tokenizer, expected: dict[str, int] | None = None) -> Tokenizer:
    """The tokenizer, if it has an id for each token of the template, all different, and those that are expected; else it fails."""
    missing = [t for t in (BOS, EOS, PAD) if tokenizer.special.get(t) is None]
    if missing:
        raise ValueError(f"the tokenizer has no id for {', '.join(missing)}")
    if len(set(tokenizer.special.values())) < len(tokenizer.special):
        raise ValueError("tokens of the template share an id")
    for token, i in (expected or {}).items():
        if tokenizer.special.get(token) != i:
            raise ValueError(f"{token} has id {tokenizer.special.get(token)} and not {i}")
    return tokenizer
