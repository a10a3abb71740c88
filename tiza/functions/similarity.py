"""Sorensen-Dice likeness over multisets of character pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(text: Column) -> Column:
    """Adjacent character pairs of a text without white space, numbered among equals: (pair, 1), (pair, 2), ... make a set."""
    t = F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", "")
    raw = F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    s = F.array_sort(raw)
    return F.transform(s, lambda p, i: F.concat(p, (i - F.array_position(s, p) + 2).cast("string")))


def dice_of(a: Column, b: Column, a_pairs: Column, b_pairs: Column) -> Column:
    """Likeness of two texts whose pairs are already there: 1 if equal without blanks, 0 if either is shorter than two."""
    bare = lambda x: F.regexp_replace(x, r"[ \t\n\r\f\x0b]+", "")
    both = F.size(F.array_intersect(a_pairs, b_pairs))
    total = F.size(a_pairs) + F.size(b_pairs)
    return F.when(bare(a) == bare(b), F.lit(1.0)).when((F.size(a_pairs) == 0) | (F.size(b_pairs) == 0), F.lit(0.0)).otherwise(2.0 * both / F.nullif(total, F.lit(0)))


def dice(a: Column, b: Column) -> Column:
    return dice_of(a, b, pairs(a), pairs(b))
