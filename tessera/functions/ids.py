"""Column builders for arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the label of tokens that don't count.
IGNORED = -100


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def right_padded(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")))


def left_padded(ids: Column, size: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")), ids)


def padded_size(size: Column, multiple: int = 1) -> Column:
    """The next multiple."""
    return (F.ceil(size / multiple) * multiple).cast("int")


def trimmed(ids: Column, eos: int, pad: int) -> Column:
    """Up to the first end, without padding at the end (if padding isn't the end)."""
    at = F.array_position(ids, eos)
    cut = F.when(at > 0, F.slice(ids, 1, (at - 1).cast("int"))).otherwise(ids)
    if eos == pad:
        return cut
    last = F.array_max(F.transform(cut, lambda x, i: F.when(x != pad, i + 1).otherwise(0)))
    return F.slice(cut, 1, F.coalesce(last, F.lit(0)).cast("int"))


def positions(mask: Column) -> Column:
    """Running sum of the mask less one, at least 0. Zeros and then ones, as left padding has it, take linear time."""
    first = F.array_position(mask, 1)
    padded = F.transform(mask, lambda x, i: F.greatest(F.lit(0), (i + 1 - first).cast("int")) * x)
    summed = F.transform(mask, lambda _, i: F.greatest(F.lit(0), F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, x: a + x) - 1))
    return F.when(F.array_sort(mask) == mask, padded).otherwise(summed)


def supervised(labels: Column) -> Column:
    """Labels that count; the first has nothing before it to predict it."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED))
