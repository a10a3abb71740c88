"""Sinks: event lines, CSV, a table document, keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery

from tiza.functions.text import line_breaks
from tiza.operators.batching import CHUNK, WAVE, chunked


def write_event_lines(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def protocol(results: DataFrame, order: str, size: int = CHUNK, wave: int = WAVE) -> DataFrame:
    """(place, value): the JSON lines of a batch's results(groupId, success, data, error, ...): meta, a result for each row by the order, a number, then done."""
    r = chunked(results, order, ["groupId"], size, wave)
    line = F.to_json(F.struct(F.lit("result").alias("type"), F.col("chunk_no").cast("int").alias("batchIndex"), "groupId", "success", "data", "error"))
    n = results.agg(F.count("*").alias("n"))  # one row
    meta = F.to_json(F.struct(F.lit("meta").alias("type"), F.col("n").alias("totalItems"), F.ceil(F.col("n") / size).alias("totalBatches"), F.lit(size).alias("batchSize"), F.lit(wave).alias("maxConcurrent")))
    ends = n.select(F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("place"), meta.alias("value")), F.struct(F.lit(2**62).alias("place"), F.lit('{"type":"done"}').alias("value")))))
    return r.select(F.col("item_no").cast("long").alias("place"), line.alias("value")).unionByName(ends)


def write_protocol(results: DataFrame, folder: str, order: str, files: int = 1) -> None:
    """The lines of protocol() as text files, whose names' order is that of the lines. A folder that exists is written anew, so that meta and done stand once."""
    lines = protocol(results, order).repartitionByRange(files, "place").sortWithinPartitions("place")
    lines.select("value").write.mode("overwrite").text(folder)


def stream_protocol(results: DataFrame, folder: str, checkpoint: str, order: str, files: int = 1) -> StreamingQuery:
    """A micro-batch is a request: its lines go to folder/batch=<number>, the same ones however often it runs; one without rows has none."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_protocol(batch, f"{folder}/batch={number}", order, files)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_csv(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").option("header", True).csv(path)


def write_table_document(groups: DataFrame, path: str, columns: list[str]) -> None:
    """One HTML table row per line, newlines as breaks: word processors open the parts put together."""
    cells = [F.concat(F.lit("<td>"), line_breaks(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    groups.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(path)


def first_and_rest(corrections, n: int = 5):
    """The first n elements of an array and the others, as a report's first page and its next ones."""
    return F.slice(corrections, 1, n), F.slice(corrections, n + 1, F.greatest(F.size(corrections) - n, F.lit(0)))
