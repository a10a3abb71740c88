"""Rows that pass and rows that don't, in one scan: nothing is lost, and each rejected row says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiza.functions import json_repair


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `reasons`: the names of the rules that fail, in their order; a rule that gives null fails."""
    failed = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("reasons", F.filter(failed, lambda x: x.isNotNull()))


def parsed_replies(df: DataFrame, raw: Column) -> DataFrame:
    """df with `reply`, a raw reply's fields with defaults, and `reasons`: what makes it unusable; then reply is null."""
    v = df.withColumn("_v", json_repair.parsed(raw, f"{json_repair.SCHEMA},malformed string", {"columnNameOfCorruptRecord": "malformed"}))
    v = with_reasons(v, {"no JSON object": F.col("_v.malformed").isNull() & F.col("_v").isNotNull(), "no puntaje": F.col("_v.puntaje") != "", "no retroalimentacion": F.col("_v.retroalimentacion").isNotNull()})
    return v.withColumn("reply", F.when(F.size("reasons") == 0, json_repair.with_defaults(F.col("_v")))).drop("_v")


def split(df: DataFrame, folder: str, mode: str = "overwrite") -> dict[str, int]:
    """Writes df(reasons, ...) below folder as outcome=accepted and outcome=rejected in one pass; the number of rows in all, accepted and rejected."""
    seen = Observation()
    bad = F.size("reasons") > 0
    counted = df.observe(seen, F.count("*").alias("rows"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    counted.withColumn("outcome", F.when(bad, "rejected").otherwise("accepted")).write.mode(mode).partitionBy("outcome").parquet(folder)
    return {k: v or 0 for k, v in seen.get.items()}


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") > 0)


def split_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """As split() for each micro-batch, below folder/batch=<number>; a batch that runs again writes over its own folder."""
    return df.writeStream.foreachBatch(lambda batch, number: split(batch, f"{folder}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
