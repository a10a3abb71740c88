"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = "[\\x20\\x09-\\x0D]+"
#: Upper and lower case of the 26 ASCII letters, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (local tests) a temporary folder takes its place."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_checkpoints(spark)
    return f"{root.rstrip('/')}/tiza-{uuid.uuid4().hex}"


def local_checkpoints(spark: SparkSession) -> str:
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tiza-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that later steps neither recompute it nor lose it with an executor."""
    if not df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        local_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed, but as compressed Parquet below the shared folder: less disk where rows hold texts or many numbers."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Freed memory that Arrow's pool and the C library hold on to goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that releases memory at the end of each task.

    Spark keeps Python workers for later tasks, so what one holds on to would stand beside the Java heap in the steps that follow."""

    @wraps(run)
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return then


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RE))


def packed(df: DataFrame) -> DataFrame:
    """All columns of df as one struct column `row`, so that no column name can clash with an operator's own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def placed(docs: DataFrame) -> DataFrame:
    """(file, place, row): every row of docs as a struct, named by its file and its number there.

    The names are the same whenever docs is read again, however its files are then split among tasks. A docs whose rows don't
    stem one by one from files (made in memory, joined, exploded) is first written to the shared folder. file is a hash of
    the path: two of a million paths share one with probability 3e-8, and only rows of equal number would be confused."""
    rows = packed(docs)
    try:
        out = rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "row")
        if out.groupBy("file", "place").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return out
    except AnalysisException:
        pass
    return stored(rows.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"), "row"))


def beta_strength(total: Column, mean: Column, weighted_var: Column, groups: Column) -> Column:
    """Pseudo-count of a beta prior by the method of moments, between 1 and 1e6.

    weighted_var: size-weighted variance of the groups' rates; its binomial part is mean (1 - mean) groups / total."""
    spread = mean * (1 - mean)
    between = F.greatest(weighted_var - spread * groups / total, F.lit(1e-9))
    return F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(1e6))


def join_by_key(left: DataFrame, right: DataFrame, key: str, count: str, heavy: int = 1000, spread: list[str] | None = None) -> DataFrame:
    """left join of right(key, count, values...), one row per non-null key, onto left's rows, without a hot task.

    Keys with 1 / heavy or more of all counted rows, of which there are at most `heavy`, are looked up in a broadcast of
    that proven size. Only the others need the shuffle; rows already served are dealt out by a hash of the columns in `spread`, all of left's without it."""
    values = [c for c in right.columns if c not in (key, count)]
    total = right.agg(F.sum(count).alias("_total"))  # one row
    r = right.join(F.broadcast(total)).select(F.col(key).alias("_key"), F.col(count).alias("_count"), F.struct(*values).alias("_value"), (F.col(count) * heavy >= F.col("_total")).alias("_hot"))
    hot = r.where("_hot").select(F.col("_key").alias("_hot_key"), F.col("_value").alias("_hot_value"))
    # a plain -1 would be folded out of the join's keys, and served rows would again meet in one task
    cold = r.where("not _hot").select(F.col("_key").alias("_cold_key"), F.when(F.col("_count") > 0, -1).alias("_cold_salt"), F.col("_value").alias("_cold_value"))
    served = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    at = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    at = at.withColumn("_salt", F.when(served, F.pmod(F.xxhash64(*[F.col(c) for c in spread or left.columns]), F.lit(1000)).cast("int")).otherwise(-1))
    out = at.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    out = out.withColumn("_value", F.coalesce("_hot_value", "_cold_value"))
    return out.select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])
