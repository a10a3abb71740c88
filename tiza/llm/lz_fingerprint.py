"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into dictionary phrases: each phrase is the shortest piece not yet in the dictionary, and joins it.
The hashes of the phrase set form a set whose minimum-hash signature, its SIGNATURE smallest hashes, is the fingerprint; two
fingerprints' likeness is the share of the smallest hashes of their union that both hold, an estimate of the phrase sets'
Jaccard likeness. Like compression it rates shared substrings of all lengths.

Null and empty texts have the empty fingerprint, which is like itself (1) and unlike others (0). Null ids come last. Rows may
share an id or be equal in all: they go by their texts' hashes, then by their places in files, so that ranges cut them too. Texts
are parsed whole, however long; a task holds a text, its neighbour and their phrases. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import placed, stored, table

SIGNATURE = 64
#: Documents in a range bucket, and the most buckets, whose bounds, 40 bytes each, pass through the driver. Tasks stream through
#: their buckets, so that with more rows than both allow a task takes longer but needs no more memory.
BUCKET_ROWS, MAX_BUCKETS = 2000, 100_000
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(data: bytes, seen: set[bytes], start: int = 0) -> int:
    """Adds the phrases of data[start:] to seen; returns where the last, unfinished phrase begins.

    The dictionary holds every prefix of its phrases, so the search may begin at the length of the phrase before."""
    n, i, guess, add = len(data), start, 4, seen.add
    while i < n:
        j = i + guess
        if data[i:j] in seen:
            j += 1
            while j <= n and data[i:j] in seen:
                j += 1
            if j > n:
                break
        else:
            j -= 1
            while j > i and data[i:j] not in seen:
                j -= 1
            j += 1
        add(data[i:j])
        guess = j - i
        i = j
    return i


def signature(seen: set[bytes], size: int = SIGNATURE) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh32_intdigest, seen), np.uint32, len(seen))
    if len(h) > 2 * size:
        h = np.partition(h, 2 * size)[: 2 * size]
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:size]
    return float(np.isin(low, a).dot(np.isin(low, b).astype(np.int64)) / len(low))


def fingerprint(text: str | None, size: int = SIGNATURE) -> np.ndarray:
    seen: set[bytes] = set()
    phrases((text or "").encode(), seen)
    return signature(seen, size)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many code points from the start of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def both_fingerprints(text: str, following: str, size: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray, str]:
    """Of the text and of its edited form, which share the parse of their common start; and the edited form's SHA-256."""
    third = len(text) // 3
    start, end, swap = text[: len(text) - third].encode(), text[len(text) - third :].encode(), following[:third].encode()
    seen: set[bytes] = set()
    at = phrases(start, seen)
    other = set(seen)
    phrases(start[at:] + end, seen)
    phrases(start[at:] + swap, other)
    return signature(seen, size), signature(other, size), hashlib.sha256(start + swap).hexdigest()


def as_string(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, size: int = SIGNATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row: a map over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_string(fingerprint(t.as_py(), size)) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


PLACE = ["doc_id", "tie", "file", "place"]


def _codes(doc_id: np.ndarray, missing: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Strings of bytes that sort as the documents do: descending by id, missing ids last, then descending by the rest."""
    falling = [~(x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for x in (np.where(missing, 0, doc_id), *rest)]
    return np.ascontiguousarray(np.stack([missing.astype(np.uint64), *falling], 1).astype(">u8")).view(f"S{8 * len(falling) + 8}").ravel()


def _in_order(docs: DataFrame, bucket_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(bucket, borrowed, doc_id, text), sorted in each partition so that every document is followed by the next one.

    Order: as PLACE, descending, null ids last; after the last comes the first. The places are range-partitioned; each range's
    first place is a bound. A range also borrows the first document of the range after it, so one text per range moves twice."""
    rows = placed(docs).select("file", "place", F.col(f"row.`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = stored(rows.select(*PLACE))
    parts = max(1, min(MAX_BUCKETS, -(-keys.count() // bucket_rows)))
    ranges = keys.repartitionByRange(parts, F.desc_nulls_last("doc_id"), *[F.desc(c) for c in PLACE[1:]]).withColumn("part", F.spark_partition_id())
    # one row per range, at most MAX_BUCKETS
    firsts = ranges.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), *PLACE)).alias("first")).select("first.*").collect()
    columns = [np.array([r[c] if r[c] is not None else 0 for r in firsts], np.int64) for c in PLACE]
    bounds = np.sort(_codes(columns[0], np.array([not r.known for r in firsts], bool), *columns[1:]))

    @F.pandas_udf("bucket int, lend_to int")
    def bucket_of(ids, missing, tie, file, place):
        codes = _codes(ids.to_numpy(), missing.to_numpy(), tie.to_numpy(), file.to_numpy(), place.to_numpy())
        bucket = np.searchsorted(bounds, codes, "right") - 1
        lend = np.where(bounds[bucket] == codes, (bucket - 1) % len(bounds), -1)
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "lend_to": lend.astype(np.int32)})

    at = bucket_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tie", "file", "place")
    places = F.array(F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("borrowed")), F.struct(F.col("at.lend_to").alias("bucket"), F.lit(True).alias("borrowed")))
    dealt = rows.withColumn("at", at).select(*PLACE, "text", F.inline(F.filter(places, lambda p: p["bucket"] >= 0)))
    dealt = dealt.repartition(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", "borrowed", F.desc_nulls_last("doc_id"), *[F.desc(c) for c in PLACE[1:]])
    return dealt.select("bucket", "borrowed", "doc_id", "text")


def edited_likeness(docs: DataFrame, size: int = SIGNATURE, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for each row: fingerprints of the text and of its edited text, and their likeness, and the next document's.

    A task streams through its ranges and holds two texts at a time. Rows with equal id and text are one another's next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        done: list[tuple] = []
        bucket = before = waiting = None  # waiting: its text waits for the next one; before: its result waits for the next fingerprint

        def settle(own: np.ndarray) -> None:
            nonlocal before
            if before:
                doc_id, n, sha, fp, ed = before
                done.append((doc_id, n, sha, as_string(fp), as_string(ed), likeness(fp, ed, size), likeness(fp, own, size)))
                before = None

        for batch in batches:
            for b, borrowed, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                text = text.as_py()
                if b != bucket:
                    bucket, before, waiting = b, None, None
                if waiting:
                    fp, ed, sha = both_fingerprints(waiting[1], text, size)
                    settle(fp)
                    before = (waiting[0], len(waiting[1]), sha, fp, ed)
                if borrowed and waiting:
                    settle(fingerprint(text, size))
                waiting = None if borrowed else (doc_id, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []

    return _in_order(docs, bucket_rows, id_col, text_col).mapInArrow(run, RESULT)


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
