"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the least order columns of each key, other columns breaking ties.

    A minimum over structs combines before the shuffle, so a key with very many rows costs one row per task; a ranking window
    would gather and sort them all."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(least).select(*[F.col(k) if k in keys else F.col(f"_first.`{k}`") for k in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of each key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    most = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*keys).agg(most).select(*[F.col(k) if k in keys else F.col(f"_last.`{k}`") for k in df.columns])


def first_of_each(array: Column, key) -> Column:
    """An array without elements whose key occurred before, in order."""
    keys = F.transform(array, key)
    return F.filter(array, lambda x, i: F.array_position(keys, key(x)) == i + 1)
