"""Edit distance in time that follows the longer text's machine words, not its letters, for each letter of the shorter one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _shared(a: str, b: str) -> int:
    """How many letters both texts begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of code points between two texts (Levenshtein).

    What both begin and end with costs nothing. Of the rest a whole column of the table is worked out at once, as the bits of
    two integers: where the number grows from one row to the next, and where it falls (Myers 1999, Hyyrö 2003).
    """
    head = _shared(a, b)
    a, b = a[head:], b[head:]
    tail = _shared(a[::-1], b[::-1])
    a, b = sorted((a[: len(a) - tail], b[: len(b) - tail]), key=len)
    if not a:
        return len(b)
    places: dict[str, int] = {}
    bit = 1
    for c in b:
        places[c] = places.get(c, 0) | bit
        bit <<= 1
    every = bit - 1
    grows, falls = every, 0
    for c in a:
        same = places.get(c, 0)
        level = ((((same & grows) + grows) ^ grows) | same) & every
        right = (falls | (every ^ (level | grows))) << 1 | 1
        left = (grows & level) << 1
        keeps = same | falls
        falls = right & keeps & every
        grows = (left | ~(keeps | right)) & every
    return len(a) + grows.bit_count() - falls.bit_count()


@F.arrow_udf(IntegerType())
def levenshtein(a: pa.Array, b: pa.Array) -> pa.Array:
    """distance of two columns; null where one is null. As the built-in function of this name, which compares every letter with every other."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())
