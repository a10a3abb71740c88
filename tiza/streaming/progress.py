"""Structured Streaming over event lines: counters, debits that count once, closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.sources.readers import EVENT


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Event lines as their files arrive; malformed lines drop out, failed items are rows like others."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def counters(events: DataFrame) -> DataFrame:
    """Results so far by success: the state is one row for each outcome."""
    return events.where("type = 'result'").groupBy("success").agg(F.count("*").alias("n"))


def once_within(entries: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Entries whose operation hasn't occurred within the watermark's delay: the state forgets what is older."""
    return entries.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys])


def closed(running: DataFrame, events: DataFrame, message: str) -> DataFrame:
    """Groups that still run when their stream has failed, with the error."""
    done = events.where("type = 'result'").select(F.col("groupId").alias("group_id"))
    return running.join(done, "group_id", "left_anti").withColumn("error", F.lit(message))
