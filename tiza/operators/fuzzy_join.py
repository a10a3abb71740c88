"""Matching question names to score-sheet items where either may contain the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiza.functions.text import normal_key
from tiza.operators.lineage import checkpointed


def _lengths(df: DataFrame, key: str) -> Column:
    """The distinct lengths of a column's texts, as an array: no more than the longest one is long."""
    return df.agg(F.array_sort(F.collect_set(F.length(key)))).scalar()


def substrings(text: Column, lengths: Column) -> Column:
    """The distinct parts of a text that have one of the lengths."""
    n = F.length(text)
    starts = lambda m: F.when(m <= n, F.sequence(F.lit(1), F.when(m == 0, 1).otherwise(n - m + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda m: m <= n), lambda m: F.transform(starts(m), lambda i: F.substr(text, i, m)))))


def match_items(questions: DataFrame, items: DataFrame, on: list[str] | None = None, compat: bool = False) -> DataFrame:
    """questions(question, ...) with item_id and item_max: the matching item of items(pos, id, max_score).

    Names match if equal or if one contains the other, after trimming and upper case. Equal names go first, then the first by
    position; compat takes the first by position alone, so SM10 gets SM1. No match: null and 1.

    on: columns that both sides share, such as the exam. Parts of the names are joined by equality: a question's parts, of the
    lengths that item names have, with the items; an item's parts, of the lengths that questions have, with the questions. Each
    part keeps its first item before the join, and distinct questions are matched once, so neither a long list nor many
    questions meet all at once."""
    on = on or []
    # both are looked at several times; written, they are worked out once, and their sizes are known
    q = checkpointed(questions.select(*on, "question", normal_key(F.col("question")).alias("_key")).where("_key is not null").distinct())
    i = items.select(*on, normal_key(F.col("id")).alias("_key"), F.struct("pos", "id", "max_score").alias("_item")).where("_key is not null")
    own = checkpointed(i.groupBy(*on, "_key").agg(F.min("_item").alias("_item")))
    cut = lambda df, other: df.withColumn("_lengths", _lengths(other, "_key")).withColumn("_part", F.explode(substrings(F.col("_key"), F.col("_lengths"))))
    parts = cut(own, q).groupBy(*on, F.col("_part").alias("_key")).agg(F.min("_item").alias("_holds"))
    held = cut(q, own).join(own.withColumnRenamed("_key", "_part"), [*on, "_part"])
    held = held.groupBy(*on, "_key").agg(F.min("_item").alias("_held"))
    found = q.join(own.withColumnRenamed("_item", "_equal"), [*on, "_key"], "left").join(parts, [*on, "_key"], "left").join(held, [*on, "_key"], "left")
    first = F.least("_holds", "_held")
    best = found.select(*on, "question", (first if compat else F.coalesce("_equal", first)).alias("_best")).where("_best is not null")
    names = [*on, "question"]
    best = best.select(*[F.col(c).alias(f"_r_{c}") for c in names], "_best")
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    out = questions.join(best, same, "left")
    return out.select(*questions.columns, F.col("_best.id").alias("item_id"), F.coalesce(F.col("_best.max_score"), F.lit(1)).alias("item_max"))
