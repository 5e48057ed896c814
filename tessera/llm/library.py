"""Ids by the tokenizers library, for byte-level BPE files: the library encodes each distinct piece, and equal pieces of a batch share its ids.

``encoder`` takes a text as plain characters. ``text_encoder`` gives the ids of the library's plain call without template tokens:
the file's added tokens are found first, and have their own ids.
"""

from __future__ import annotations

import os
import re
from functools import cache, lru_cache

import numpy as np

from .pieces import PieceEncoder, classes_by

#: Pieces that go to the library as one pretokenised text.
TOGETHER = 512


class LibraryMerger:
    """Distinct pieces to ids. Each piece is a pretokenised word, so that nothing merges across pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            found = self.own.encode_batch([some], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)


class TextEncoder:
    """Whole texts to ids, with the file's added tokens. Texts are cut at these before the piece scan; what is between two of them is a text
    of its own to the library, and so here. Added tokens that take white space or need word borders leave their texts to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = encoder(path)
        added = self.own.merge.own.get_added_tokens_decoder()
        self.ids = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")")
        simple = all(not (t.single_word or t.lstrip or t.rstrip) for t in added.values()) and len({t.normalized for t in added.values()}) < 2
        self.plain = None if simple else Tokenizer.from_file(path)

    def parts(self, text: str) -> list:
        """Texts at even places, ids of tokens between them."""
        if not any(t in text for t in self.ids):
            return [text]
        if self.plain is None:
            out: list = self.cut.split(text)
            out[1::2] = [self.ids[t] for t in out[1::2]]
        else:
            ids = self.plain.encode(text, add_special_tokens=False).ids
            out = [""] * (2 * len(ids) + 1)
            out[1::2] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin in it, with the end."""
        parts = [self.parts(t) for t in texts]
        many = np.fromiter((len(p) // 2 for p in parts), np.int64, len(parts))
        if not many.any():
            return self.own.encode(texts)
        ids, offsets = self.own.encode([x for p in parts for x in p[::2]])
        last = np.cumsum(many + 1)
        followed = np.delete(offsets[1:], last - 1)
        tokens = np.array([x for p in parts for x in p[1::2]], ids.dtype)
        return np.insert(ids, followed, tokens), np.append(0, offsets[last] + np.cumsum(many))


@cache
def library_classes(path: str) -> np.ndarray:
    """The classes that the file's splitter goes by."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path).pre_tokenizer
    return classes_by(lambda text: np.array([a for _, (a, _) in own.pre_tokenize_str(text)], np.int64))


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One of each worker, kept from task to task."""
    return PieceEncoder(LibraryMerger(path), kinds=library_classes(path))


@lru_cache(2)
def text_encoder(path: str) -> TextEncoder:
    """One of each worker, kept from task to task."""
    return TextEncoder(path)
