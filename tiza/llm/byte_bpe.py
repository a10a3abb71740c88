"""Byte-level BPE encoding and decoding over a shuffle of distinct words.

1. Texts are cut into pre-tokens. Each block of documents keeps its pre-tokens as numbers of its own distinct words, in
   order: that is every pre-token's position, packed.
2. One shuffle deals out both: a block's distinct words by hash to word buckets, its sequence by the block's name. All blocks'
   copies of a word meet in one bucket, where the word is merged once, and only its ids go on to the blocks that asked.
3. Each block, whose sequence lies there already, joins the ids to its positions and emits the ids of each document.
4. Decoding joins ids to the table of token bytes, which is as small as the vocabulary.

Texts are read once, but for a sum of their lengths, from which the numbers of partitions and buckets follow. Hot words weigh
nothing: a block sends a word once, however often it occurs. Memory: a block (BLOCK_CHARS of text, or one longer text) or a
bucket's distinct words. A text is never cut: a single very long one makes one block.

Null texts count as empty: no ids, no bytes. Rows and doc_ids may repeat; each row gives one row.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiza.llm.common import release, releasing, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLOCK_CHARS = 8_000_000
#: Characters of text for each partition of the shuffle: SMALL until there are MANY partitions, then LARGE.
SMALL, LARGE, MANY = 16_000_000, 64_000_000, 200
#: Word buckets for each partition, within bounds: few words a bucket make poor payloads, many a large table.
PER_PARTITION, BUCKETS = 4, (256, 65_536)
SEQUENCE = -1  # bucket number of a block's own row
SEGMENT = "key bigint, block bigint, bucket int, payload binary"
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pair and (low := min(pair)) < 1 << 30:
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, in n log n: a heap of pairs over a linked list."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 4-byte numbers, each split into byte planes, which compress better."""
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    planes = b"".join(np.ascontiguousarray(a.astype("<u4").view("u1").reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.compress(np.uint32(len(arrays)).tobytes() + head + planes, 3)


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(payload), "u1")
    sizes = raw[4 : 4 + 4 * int(raw[:4].view("<u4")[0])].view("<u4")
    at, out = 4 + 4 * len(sizes), []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _words(payload: bytes) -> list[bytes]:
    raw = zstandard.decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()] if n else []
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def _segments(buckets: int, block_chars: int, pattern: str):
    """(doc_id, text, part) -> SEGMENT: blocks' words by bucket (key: the bucket) and their sequences (key: the block)."""
    split = regex.compile(pattern).findall

    def block_rows(numbers: dict[str, int], ids: list, codes: list[np.ndarray], digest: bytes) -> Iterator[tuple]:
        block = int.from_bytes(digest, "little", signed=True)
        words = [w.encode() for w in numbers]
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = [words[i] for i in order[bounds[b] : bounds[b + 1]]]
            lengths = np.array([len(own), *map(len, own)], "<u4").tobytes()
            yield b, block, b, zstandard.compress(lengths + b"".join(own), 3)
        none = np.array([i is None for i in ids], np.uint32)
        whole = np.array([0 if i is None else i for i in ids], np.int64).view("<u4")
        seq = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        yield block, block, SEQUENCE, _pack(none, whole, np.array([len(c) for c in codes], np.uint32), seq, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = 0

        def fresh():
            d = defaultdict()
            d.default_factory = d.__len__
            # a block's name follows from its partition, place and content, so a task that runs again names it the same
            return d, [], [], 0, blake2b(f"{index}".encode(), digest_size=8)

        def out(rows: Iterator[tuple]) -> pa.RecordBatch:
            key, block, bucket, payload = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["key", "block", "bucket", "payload"])

        numbers, ids, codes, size, digest = fresh()
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else None
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = split(text)
                ids.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                digest.update(f"{part}:{doc_id}:{len(words)}:{zlib.crc32(text.encode())}".encode())
                size += len(text) + 100
                if size >= block_chars:
                    yield out(block_rows(numbers, ids, codes, digest.digest()))
                    index += 1
                    numbers, ids, codes, size, digest = fresh()
        if ids:
            yield out(block_rows(numbers, ids, codes, digest.digest()))

    return run


def _merger(shared_ranks):
    """SEGMENT sorted by bucket -> for each block's words of a bucket their ids, keyed by the block. Sequences are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, at = shared_ranks.value, {}, None
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column(2), SEQUENCE))
            payloads = []
            for bucket, payload in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                counts, ids = [], []
                for w in _words(payload.as_py()):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = tuple(merge(w, ranks))
                    counts.append(len(got))
                    ids.extend(got)
                payloads.append(_pack(np.array(counts, np.uint32), np.array(ids, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(1), batch.column(2), pa.array(payloads, pa.binary())], ["key", "block", "bucket", "payload"])

    return run


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assemble(own: pa.Table, merged: pa.Table) -> pa.Table:
    """The documents of one block, from its sequence and its words' ids. Word buckets, which lie there as well, give none."""
    own = own.filter(pc.equal(own.column("bucket"), SEQUENCE))
    if not len(own):
        return RESULT.empty_table()
    seq = _unpack(own.column("payload")[0].as_py())
    parts = {bucket: _unpack(payload.as_py()) for bucket, payload in zip(merged.column("bucket").to_pylist(), merged.column("payload"), strict=True)}
    none, whole, sizes, codes, of = seq
    doc_ids = whole.view(np.int64)
    order = np.argsort(of, kind="stable")
    empty = np.zeros(0, np.uint32)
    counts_by = np.concatenate([empty, *[parts[k][0] for k in sorted(parts)]]).astype(np.int64)
    ids = np.concatenate([empty, *[parts[k][1] for k in sorted(parts)]])
    start, count = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    start[order], count[order] = np.cumsum(counts_by) - counts_by, counts_by
    at, out = 0, []
    for n in sizes.tolist():
        c = codes[at : at + n]
        at += n
        out.append(ids[_runs(start[c], count[c])].astype("<u4").tobytes())
    doc_id = pa.array(doc_ids, mask=none.astype(bool))
    made = pa.table([doc_id, pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], schema=RESULT)
    del seq, parts, ids, out
    release()
    return made


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, buckets: int | None = None, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are packed as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0  # one number
    partitions = max(1, min(MANY, -(-chars // SMALL)), -(-chars // LARGE))
    buckets = buckets or min(max(PER_PARTITION * partitions, BUCKETS[0]), BUCKETS[1])
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # bounded by the vocabulary
    cut = rows.withColumn("part", F.spark_partition_id()).mapInArrow(releasing(_segments(buckets, block_chars, pattern)), SEGMENT).repartition(partitions, "key")
    merged = cut.sortWithinPartitions("bucket").mapInArrow(releasing(_merger(ranks)), SEGMENT)
    # both sides read the one shuffle of `cut`; sequences stay where it put them, and only the words' ids move again
    return cut.groupBy("key").cogroup(merged.groupBy("key")).applyInArrow(_assemble, ENCODED)


def decode(encoded: DataFrame, path: str = VOCABULARY, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """encoded plus the bytes that its packed ids stand for. Null ids give null; an id without a token raises an error."""
    ranks = load_ranks(path)
    tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast((b"".join(tokens), np.array([len(t) for t in tokens], np.int64)))
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, lengths = shared.value
        raw, starts = np.frombuffer(raw, "u1"), np.cumsum(lengths) - lengths
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                ids = ids.as_py()
                i = None if ids is None else np.frombuffer(ids, "<u4")
                texts.append(None if i is None else raw[_runs(starts[i], lengths[i])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(releasing(run), T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs encoded and decoded again."""
    both = decode(encode(docs, **options))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
