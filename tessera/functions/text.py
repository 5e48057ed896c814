"""Column builders for text: Unicode strip and line splitting, tokenizers as expressions, and small parsers."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's str.strip removes, as a character class of Java's and RE2's regexes.
STRIPPED = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same code points as one string.
STRIPPED_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space as Unicode has it; ``STRIPPED_CHARS`` has four separators more.
WHITE_CHARS = "".join(c for c in STRIPPED_CHARS if not "\x1c" <= c <= "\x1f")
#: Line boundaries of Python's str.splitlines.
LINE_ENDS = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Special tokens of the chat template.
BOS, EOS, PAD = "<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>", "<｜▁pad▁｜>"
SPECIALS = f"{BOS}|{EOS}|{PAD}"
#: What they all begin with: other texts have none.
BEGIN = os.path.commonprefix([BOS, EOS, PAD])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """As Python's str.strip; Spark's trim alone removes spaces only."""
    return F.btrim(col(c), F.lit(STRIPPED_CHARS))


def optional(c: Column | str) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def lines(c: Column | str) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(col(c), LINE_ENDS, -1), strip), lambda x: x != "")


def char_tokens(c: Column | str) -> Column:
    """Special tokens, and otherwise one token for each code point."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?s)({SPECIALS}|.)"), 1)


def char_count(c: Column | str) -> Column:
    """How many ``char_tokens`` there are, without making them."""
    out = col(c)
    for token in (BOS, EOS, PAD):
        out = F.replace(out, F.lit(token), F.lit("x"))
    return F.char_length(F.when(F.contains(col(c), F.lit(BEGIN)), out).otherwise(col(c)))


def char_ids(c: Column | str) -> Column:
    """Ids of ``char_tokens``: code points, and special tokens beyond them. Only texts that may have such a token go through a regex."""
    special = {t: 0x110000 + i for i, t in enumerate((BOS, EOS, PAD))}

    def one(t: Column) -> Column:
        out = F.ascii(t)
        for token, i in special.items():
            out = F.when(t == token, F.lit(i)).otherwise(out)
        return out

    plain = (col(c) != "") & ~F.contains(col(c), F.lit(BEGIN))
    return F.when(plain, F.transform(F.split(col(c), ""), F.ascii)).otherwise(F.transform(char_tokens(c), one))


def space_tokens(c: Column | str) -> Column:
    """Parts between single spaces, where a line feed is a part of its own."""
    return F.filter(F.split(F.regexp_replace(col(c), "\n", " \n "), " ", -1), lambda x: x != "")


def space_count(c: Column | str) -> Column:
    return F.size(space_tokens(c))


TOKENIZERS = {"char": char_count, "space": space_count}


def short_answer(c: Column | str) -> Column:
    """An answer without outer white space and marks, and without any white space inside."""
    marks = "[。；;，,：:]"
    return F.regexp_replace(F.regexp_replace(strip(c), rf"\A{marks}+|{marks}+\z", ""), rf"{STRIPPED}+", "")


def human_count(c: Column | str) -> Column:
    """With B, M or K and two decimals."""
    n = col(c)
    out = F.format_string("%d", n.cast("long"))
    for size, name in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(n >= size, F.format_string(f"%.2f{name}", n / size)).otherwise(out)
    return out


def numbers(c: Column | str) -> Column:
    """Floats between commas and white space; fails on none, and on any that isn't above 0."""
    parts = F.transform(F.filter(F.split(col(c), r"[,\s]+", -1), lambda x: x != ""), lambda x: x.cast("double"))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x > 0), parts).otherwise(F.raise_error(F.lit("factors must be positive numbers")).cast("array<double>"))


def named_value(c: Column | str) -> Column:
    """name=value as a struct of both."""
    parts = F.split(col(c), "=", 2)
    return F.struct(parts[0].alias("name"), parts[1].alias("value"))
