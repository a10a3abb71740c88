"""Lookups, patches, upserts and merges of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiza.operators.dedupe import last_wins


def lookup(df: DataFrame, key: str, value, exactly: bool = False) -> DataFrame:
    """The row whose key has this value; more than one, or none if exactly, is an error."""
    rows = df.where(F.col(key) == value)
    n = rows.limit(2).count()
    if n > 1 or (exactly and n != 1):
        raise ValueError(f"{n or 'no'} rows where {key} is {value!r}")
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both; of a key's rows the last by the order columns."""
    return last_wins(old.unionByName(new, allowMissingColumns=True), keys, order)


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the non-null values of changes(key, ...) for the rows that have one."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = df.join(c, key, "left")
    return joined.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in fields else F.col(x) for x in df.columns])


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: str, valid: dict[str, Column]) -> DataFrame:
    """Full outer merge: each field from `over` where it is valid there, else from base. valid: conditions on o.<field>."""
    b, o = base.alias("b"), over.alias("o")
    joined = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    fields = [F.coalesce(F.when(cond, F.col(f"o.{f}")), F.col(f"b.{f}")).alias(f) for f, cond in valid.items()]
    return joined.select(F.coalesce(f"o.{key}", f"b.{key}").alias(key), *fields)


def two_steps(orders: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """orders with their plan's columns and whether it was found."""
    return orders.join(plans.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def zipped(left: Column, right: Column) -> Column:
    """Elements of left with those of right at the same place, empty where right is shorter."""
    return F.transform(left, lambda x, i: F.struct(i.alias("pos"), x.alias("right"), F.coalesce(F.get(right, i), F.lit("")).alias("given")))


def latest_valid(codes: DataFrame, owner: str, as_of: Column) -> DataFrame:
    """Each owner's newest code of codes(created_at, expires_at, used) that is unused and not yet expired."""
    return last_wins(codes.where((~F.col("used")) & (F.col("expires_at") > as_of)), [owner], ["created_at"])
