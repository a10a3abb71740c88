"""The end of streams of results: every item that was started gets an outcome, whatever becomes of its stream.

A stream's events are start (one for each item), result, done and failed. Items that are open when their stream ends, fails or
falls silent get an error row. The state of a stream is its open items, at most as many as a request may hold.

completed() keeps a few streams with timers of their own; complete_batches() settles the many streams of a micro-batch at once by
windows, with the open items in files."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tiza.streaming.state import folder_of, numbers

#: What transformWithState needs: state that holds several variables and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "stream string, groupId string, success boolean, data string, error string, closed_by string"
_ROW = Row("stream", "groupId", "success", "data", "error", "closed_by")


class Completion(StatefulProcessor):
    """Outcomes of one stream's items; silent: milliseconds without events after which the stream counts as lost."""

    def __init__(self, silent: int, event_time: bool, ended: str, lost: str):
        self.silent, self.event_time, self.ended, self.lost = silent, event_time, ended, lost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "groupId string", "started bigint")

    def _closed(self, stream: str, groups, error: str, closed_by: str) -> list[Row]:
        return [_ROW(stream, group, False, None, error, closed_by) for group in sorted(groups)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (stream,) = key
        # the state is read once and only what has changed is written: each access to it is a message to the JVM
        before = {group: since for (group,), (since,) in self.open.iterator()} if self.open.exists() else {}
        still, latest = dict(before), 0
        for r in sorted(rows, key=lambda r: r.order):  # at most what a request holds, and its results
            latest = max(latest, r.at or 0)
            if r.type == "start" and r.groupId is not None:
                still[r.groupId] = r.order
            elif r.type == "result":
                yield _ROW(stream, r.groupId, bool(r.success), r.data, r.error, "result")
                still.pop(r.groupId, None)
            elif r.type in ("done", "failed"):
                yield from self._closed(stream, still, self.ended if r.type == "done" else r.error or self.lost, r.type)
                still.clear()
        for group in before.keys() - still.keys():
            self.open.removeKey((group,))
        for group in still.keys() - before.keys():
            self.open.updateValue((group,), (still[group],))
        if before:  # a stream has a timer as long as items are open
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if still:
            self.handle.registerTimer((latest if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._closed(key[0], [group for (group,) in self.open.keys()], self.lost, "timeout")
        self.open.clear()

    def close(self) -> None:
        pass


def completed(events: DataFrame, silent: int = 300_000, event_time: bool = False, ended: str = "No result in the stream", lost: str = "The stream was lost") -> DataFrame:
    """(stream, groupId, success, data, error, closed_by): an outcome of each started item, and each result.

    events(stream, order, at, type, groupId, success, data, error): `order` orders a stream's events, starts first. Results come as they are; a
    later one of an item comes as well. `done` and `failed` close what is open; so does a timer after `silent` milliseconds without
    events, of processing time, or of event time by the column `at` (a timestamp with a watermark). The session must use PROVIDER; a stream
    that is to end with its input needs spark.sql.streaming.noDataMicroBatches.enabled off with timers of processing time."""
    at = F.unix_millis("at") if event_time else F.lit(None).cast("long")
    named = events.select("stream", F.col("order").cast("long").alias("order"), *(["at"] if event_time else []), "type", "groupId", "success", "data", "error", at.alias("_at"))
    # the event-time column itself stays among the rows: the watermark goes by it
    rows = named.withColumnRenamed("at", "time").withColumnRenamed("_at", "at")
    return rows.groupBy("stream").transformWithState(Completion(silent, event_time, ended, lost), OUTCOME, "Append", "EventTime" if event_time else "ProcessingTime")


#: What a batch writes: outcomes, and the items still open, with when their stream was last heard of.
SETTLED = f"{OUTCOME}, seen bigint, open boolean"


def settled(events: DataFrame, still: DataFrame, now: int, silent: int, ended: str, lost: str) -> DataFrame:
    """SETTLED rows from a batch's events and the items still(stream, groupId, seen) open before it, at the time now in milliseconds.

    An item is closed by the first end after its start, unless its result, or another start of it, comes before that end."""
    is_end, none = F.col("type").isin("done", "failed"), F.lit(None).cast("string")
    new = events.select("stream", "groupId", "type", F.lit(1).alias("round"), F.col("order").cast("long").alias("order"), "success", "data", "error", F.lit(now).cast("long").alias("seen"))
    old = still.select("stream", "groupId", F.lit("start").alias("type"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("order"), F.lit(None).cast("boolean").alias("success"), none.alias("data"), none.alias("error"), "seen")
    rows = new.unionByName(old).withColumn("rank", F.when(F.col("type") == "start", 0).when(is_end, 2).otherwise(1))
    rows = rows.withColumn("at", F.struct("round", "order", "rank")).withColumn("of_item", F.col("type").isin("start", "result"))
    back = [F.col(c).desc() for c in ("round", "order", "rank")]
    later = W.partitionBy("stream").orderBy(*back).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("heard", F.max("seen").over(W.partitionBy("stream").orderBy(*back).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("end", F.last(F.when(is_end, F.struct("at", "type", "error")), ignorenulls=True).over(later))
    rows = rows.withColumn("next", F.lag("at").over(W.partitionBy("stream", "of_item", "groupId").orderBy(*back))).where("of_item")
    result = F.col("type") == "result"
    closed = F.col("end").isNotNull() & (F.col("next").isNull() | (F.col("end.at") < F.col("next")))
    waits = F.col("end").isNull() & F.col("next").isNull()
    late = waits & (F.col("heard") + silent <= now)
    failed = F.coalesce(F.nullif("end.error", F.lit("")), F.lit(lost))
    error = F.when(result, F.col("error")).when(late, lost).when(closed & (F.col("end.type") == "done"), ended).when(closed, failed)
    by = F.when(result, "result").when(late, "timeout").when(closed, F.col("end.type"))
    kept = rows.where(result | (F.col("groupId").isNotNull() & (closed | waits)))
    good = F.coalesce(result & F.col("success"), F.lit(False))
    return kept.select("stream", "groupId", good.alias("success"), F.when(result, F.col("data")).alias("data"), error.alias("error"), by.alias("closed_by"), F.col("heard").alias("seen"), by.isNull().alias("open"))


def settle_batch(batch: DataFrame, number: int, folder: str, silent: int = 300_000, ended: str = "No result in the stream", lost: str = "The stream was lost", now: int | None = None) -> None:
    """Writes a batch's outcomes and open items below folder in one pass; a batch that runs again starts from the same items and writes over its own rows."""
    spark = batch.sparkSession

    def whole(n: int) -> bool:
        fs, p = folder_of(spark, f"{folder}/batch={n}/_SUCCESS")
        return fs.exists(p)

    earlier = [n for n in numbers(spark, folder, "batch=") if n < number and whole(n)]
    still = spark.read.schema(SETTLED).parquet(f"{folder}/batch={earlier[-1]}").where("open") if earlier else spark.createDataFrame([], SETTLED)
    now = int(time.time() * 1000) if now is None else now
    settled(batch, still.select("stream", "groupId", "seen"), now, silent, ended, lost).write.mode("overwrite").partitionBy("open").parquet(f"{folder}/batch={number}")
    for n in earlier[:-1]:  # this batch and the one before it are enough to go on or to run again
        fs, p = folder_of(spark, f"{folder}/batch={n}/open=true")
        fs.delete(p, True)


def complete_batches(events: DataFrame, folder: str, checkpoint: str, silent: int = 300_000, ended: str = "No result in the stream", lost: str = "The stream was lost") -> StreamingQuery:
    """As completed() without event time, for many streams: each micro-batch of the events settles all its streams by windows.

    The open items of all streams are written anew with each batch. There are no timers: a stream that has been silent for too long, by
    processing time, is closed by the next batch that has rows."""
    return events.writeStream.foreachBatch(lambda batch, number: settle_batch(batch, number, folder, silent, ended, lost)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The outcomes of all batches that complete_batches() has written below folder."""
    return spark.read.schema(SETTLED).parquet(folder).where("not open").drop("seen", "open", "batch")


def started(items: DataFrame, stream: str | Column, group: str) -> DataFrame:
    """Start events of items that are sent off, to be put together with a stream's own events."""
    s = F.col(stream) if isinstance(stream, str) else stream
    none = F.lit(None).cast("string")
    return items.select(s.alias("stream"), F.lit(-1).cast("long").alias("order"), F.lit("start").alias("type"), F.col(group).alias("groupId"), F.lit(None).cast("boolean").alias("success"), none.alias("data"), none.alias("error"))


def of_lines(lines: DataFrame) -> DataFrame:
    """Events of parsed lines(file, position, type, ...): a file is a stream, a line's place its order; malformed lines drop out."""
    return lines.where("malformed is null").select(F.col("file").alias("stream"), F.col("position").alias("order"), "type", "groupId", "success", "data", "error")
