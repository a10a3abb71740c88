"""Keyed state of a stream as files: each micro-batch rewrites only the buckets whose keys it holds.

Below the target are `v=<batch>/bucket=<n>` folders and a list for each batch of the version that each bucket then has. The
list before a batch is what it starts from, so a batch that runs again after a failure makes the same state. What neither
list needs is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiza.operators.dedupe import last_wins

#: Buckets that keys are dealt to by a hash. The number must stay the same for a target; its lists have a row for each.
BUCKETS = 256


def folder_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the finished folders `<prefix><n>` below the path, rising."""
    fs, p = folder_of(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.removeprefix(prefix).isdigit())


def _list(spark: SparkSession, target: str, number: int | None) -> dict[int, int]:
    """Bucket to version of the list with this number; nothing for None."""
    return {} if number is None else {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").parquet(f"{target}/lists/{number}").collect()}


def _finished(spark: SparkSession, target: str, before: int | None = None) -> int | None:
    """The newest finished list, or the newest of a batch before this one."""
    def whole(n: int) -> bool:
        fs, p = folder_of(spark, f"{target}/lists/{n}/_SUCCESS")
        return fs.exists(p)

    return next((n for n in reversed(numbers(spark, f"{target}/lists", "")) if (before is None or n < before) and whole(n)), None)


def _rows(spark: SparkSession, target: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_batch(batch: DataFrame, number: int, target: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Makes the state after this batch from that before it; each key's last row by the order columns stays.

    Of the state only the touched buckets are read and written. A batch without rows changes nothing."""
    spark = batch.sparkSession
    new = last_wins(batch, keys, order).withColumn("bucket", bucket_of(keys, buckets)).persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most a row for each bucket
        at = _finished(spark, target, number)
        before = _list(spark, target, at)
        old = _rows(spark, target, {b: before[b] for b in touched if b in before}, batch.schema).withColumn("bucket", bucket_of(keys, buckets))
        merged = last_wins(old.unionByName(new), [*keys, "bucket"], order)
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        after = before | {b: number for b in touched}
        spark.createDataFrame([*after.items()], "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{target}/lists/{number}")
    finally:
        new.unpersist()
    needed = {*before.items(), *after.items()}
    fs, root = folder_of(spark, target)
    for v in numbers(spark, target, "v="):
        for b in numbers(spark, f"{target}/v={v}", "bucket="):
            if (b, v) not in needed:
                fs.delete(folder_of(spark, f"{target}/v={v}/bucket={b}")[1], True)
        if not any(x == v for _, x in needed):
            fs.delete(folder_of(spark, f"{target}/v={v}")[1], True)
    for n in numbers(spark, f"{target}/lists", ""):
        if n not in (at, number):
            fs.delete(folder_of(spark, f"{target}/lists/{n}")[1], True)


def keep_latest(events: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts each micro-batch of the stream into the state below `target`."""
    return events.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, target, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, target: str, schema) -> DataFrame:
    """All rows of the newest state, without their buckets; none where no batch has finished."""
    return _rows(spark, target, _list(spark, target, _finished(spark, target)), schema)
