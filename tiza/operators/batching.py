"""Numbering, chunks and progress counters over a whole ordered table, without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiza.operators.lineage import checkpointed

CHUNK, WAVE = 45, 3
#: Rows in a range that one task sorts.
RANGE_ROWS = 500_000


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or max(1, -(-df.count() // RANGE_ROWS))


def running(df: DataFrame, order: str, ties: list[str], counters: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df plus running totals of the counters over all rows in the order of a column, then of the ties.

    Rows are dealt to ranges of the order; rows that are equal in it are dealt on, so that no value holds a range of its own
    together. Each range is summed by a task and begins with the totals of the ranges before it; without `parts` there are as
    many as the number of rows asks for."""
    n = _parts(df, parts)
    dealt = df.withColumns({f"_c_{c}": x.cast("long") for c, x in counters.items()}).withColumn("_tie", F.rand(11))
    dealt = dealt.repartitionByRange(n, order, *ties, "_tie").withColumn("_range", F.spark_partition_id())
    d = checkpointed(dealt) if n > 1 else dealt  # ranges must be the same for their sums and their rows
    names = list(counters)
    sums = d.groupBy("_range").agg(*[F.sum(f"_c_{c}").alias(f"_s_{c}") for c in names])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row per range
    offsets = sums.select("_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in names])
    inner = W.partitionBy("_range").orderBy(order, *ties, "_tie").rowsBetween(W.unboundedPreceding, 0)
    out = d.withColumns({c: F.sum(f"_c_{c}").over(inner) for c in names}).join(offsets, "_range")
    return out.withColumns({c: (F.col(c) + F.col(f"_o_{c}")).cast("long") for c in names}).select(*df.columns, *names)


def chunked(df: DataFrame, order: str, ties: list[str], size: int = CHUNK, wave: int = WAVE, parts: int | None = None) -> DataFrame:
    """df plus item_no from 0, chunk_no and wave_no."""
    out = running(df, order, ties, {"item_no": F.lit(1)}, parts).withColumn("item_no", F.col("item_no") - 1)
    chunk = F.floor(F.col("item_no") / size)
    return out.withColumns({"chunk_no": chunk, "wave_no": F.floor(chunk / wave)})


def chunks_needed(n: Column, size: int = CHUNK) -> Column:
    return F.ceil(n / size)


def checked_size(df: DataFrame, most: int = CHUNK * WAVE) -> DataFrame:
    """df, if it has from one to `most` rows."""
    n = df.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"a batch has from 1 to {most} items; this one has {'none' if not n else 'more'}")
    return df
