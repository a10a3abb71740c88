"""Scores and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiza.functions.numeric import grade, parse_int, pass_points
from tiza.operators.dedupe import first_wins


def development_points(detail: Column) -> Column:
    """Sum of n over the values `n/m` of a map of structs with puntaje; others count nothing."""
    return _points(detail, lambda s: F.regexp_extract(s, "^([0-9]+)/([0-9]+)$", 1).try_cast("long"))


def development_points_lenient(detail: Column) -> Column:
    """As development_points, with the integer that begins the part before the slash; bare numbers count."""
    return _points(detail, lambda s: parse_int(F.get(F.split(s, "/"), F.lit(0))).cast("long"))


def _points(detail: Column, read) -> Column:
    values = F.transform(F.map_values(detail), lambda v: F.coalesce(read(v["puntaje"]), F.lit(0).cast("long")))
    return F.coalesce(F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def maximum(items: DataFrame, keys: list[str], declared: Column) -> DataFrame:
    """(keys..., closed_max, development_max, item_max, total_max): the items' sum replaces a declared total that differs."""
    own = items.groupBy(*keys).agg(
        F.sum(F.when(~F.col("is_development"), F.col("max_score")).otherwise(0)).alias("closed_max"),
        F.sum(F.when(F.col("is_development"), F.col("max_score")).otherwise(0)).alias("development_max"),
        F.sum("max_score").alias("item_max"),
        F.max(declared).alias("_declared"),
    )
    return own.withColumn("total_max", reconciled(F.col("item_max"), F.col("_declared"))).drop("_declared")


def reconciled(item_max: Column, declared: Column) -> Column:
    total = F.when((item_max > 0) & ~item_max.eqNullSafe(declared), item_max).otherwise(declared)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(100)).otherwise(total)


def closed_score(answers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys..., score, max_score) from answers(keys, question, given, right, max_score): the first answer to a question counts."""
    once = first_wins(answers, [*keys, "question"], order)
    return once.groupBy(*keys).agg(F.sum(F.when(F.col("given") == F.col("right"), F.col("max_score")).otherwise(0)).alias("score"), F.sum("max_score").alias("max_score"))


def graded(scores: DataFrame, pct: float = 60.0) -> DataFrame:
    """scores(score, max_score) with pass points and grade."""
    s, m, p = F.col("score").cast("double"), F.col("max_score").cast("double"), F.lit(float(pct))
    return scores.withColumns({"pass_points": pass_points(m, p).cast("long"), "grade": grade(s, m, p)})


def overridden(override: Column, extracted: Column) -> Column:
    """Submitted answers, if there are any, replace the extracted ones as a whole."""
    return F.when(F.size(override) > 0, override).otherwise(extracted)
