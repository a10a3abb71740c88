"""Score sheets and answer keys: `ID:VALUE; ID:VALUE` strings to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiza.functions.numeric import parse_int
from tiza.functions.text import strip
from tiza.operators.dedupe import last_wins


def is_development(item: Column) -> Column:
    return F.lower(item).contains("desarrollo") | item.rlike("(?i)^p[0-9]+")


def pairs(df: DataFrame, text: str) -> DataFrame:
    """One row per non-blank pair with pos, id and value; what follows a second colon is ignored."""
    each = df.select("*", F.posexplode(F.split(F.col(text), ";")).alias("pos", "_pair")).where(strip(F.col("_pair")) != "")
    part = F.split(strip(F.col("_pair")), ":")
    return each.select("*", strip(F.get(part, F.lit(0))).alias("id"), strip(F.get(part, F.lit(1))).alias("value")).drop("_pair")


def score_sheet(df: DataFrame, text: str) -> DataFrame:
    """Items with pos, id, max_score and is_development. Scores that are no positive numbers drop out; repeated ids stay."""
    p = pairs(df, text).withColumn("max_score", parse_int(F.col("value"))).where("id <> '' and max_score > 0")
    return p.withColumn("is_development", is_development(F.col("id"))).drop("value")


def score_sheet_pieces(df: DataFrame, keys: list[str], piece: str, text: str) -> DataFrame:
    """As score_sheet of each key's pieces put together in their order by semicolons: pos counts through all of them.

    A piece ends between two pairs, and a piece without text is none. No row holds more than a piece."""
    own = df.where(F.col(text) != "").withColumn("_n", F.size(F.split(F.col(text), ";")))
    before = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return score_sheet(own, text).withColumn("pos", (F.col("pos") + F.col("_before")).cast("int")).drop("_n", "_before")


def score_sheet_lenient(df: DataFrame, text: str) -> DataFrame:
    """As score_sheet, but scores that are no numbers count as 0 and stay."""
    return pairs(df, text).where("id <> ''").withColumn("max_score", F.coalesce(parse_int(F.col("value")), F.lit(0))).drop("value")


def answer_key(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., id, answer): of a repeated id the last answer counts."""
    p = pairs(df, text).where("id <> '' and value <> ''")
    return last_wins(p.select(*keys, "pos", "id", F.col("value").alias("answer")), [*keys, "id"], ["pos"]).drop("pos")


def answer_key_upper(df: DataFrame, text: str) -> DataFrame:
    """As the pairs of an answer key, answers in upper case; repeated ids stay."""
    return pairs(df, text).where("id <> '' and value <> ''").withColumn("answer", F.upper("value")).drop("value")


def line_key(df: DataFrame, text: str) -> DataFrame:
    """Columns sm and vf: the comma lists of the last lines that begin with SM: and VF:."""
    lines = F.transform(F.split(F.col(text), "\n"), strip)

    def last(tag: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(tag))
        of = F.transform(F.split(F.substring(F.try_element_at(own, F.lit(-1)), len(tag) + 1, 2147483647), ","), lambda x: F.upper(strip(x)))
        return F.coalesce(of, F.array().cast("array<string>"))

    return df.select("*", last("SM:").alias("sm"), last("VF:").alias("vf"))
