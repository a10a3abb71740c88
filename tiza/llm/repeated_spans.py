"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some LENGTH-byte string that covers it also starts elsewhere, in the same text or another.

Every LENGTH-byte window is named by the least hash of the anchor-length strings in it, so equal windows have the same name
wherever they stand. Neighbouring windows with the same name form a piece of text. Names that occur once are done with, unless
the piece holds the named string twice and so may repeat itself. Of the others' pieces one of each kind, weighted by its
copies, goes to one task for each name, in which they are joined to one text with a suffix order and its Burrows-Wheeler
transform. Breadth-first backward extension then splits the interval of the empty string into the intervals of all strings of
length 1, 2, 3, ...: each new boundary is a common prefix of the current length, found in increasing order. Expansion stops at
LENGTH: suffixes still in one interval share a window there, and the window is repeated if their weights add up to two or more.

So only names, counts and one piece of each kind are shuffled, never all suffixes. Where a name's kinds are too long for one
text, as with thousands of near copies, their windows get names from longer anchors, which fewer kinds share, and so on up to
the whole window, which is a kind of its own: however hot a passage is, no task gathers it, and each window is still judged by
expansion. Kinds are told apart by hashes of 64 bits, and before bytes go each piece is compared with its kind by a digest of
128 bits; a clash raises an error.

Null texts are empty. Texts are UTF-8 bytes; matches never cross texts. Repeated rows count as repeated texts. Rows are told
apart by their places in files (common.placed). A task needs about 100 bytes of memory for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import join_by_key, placed, stored, table

LENGTH = 200
#: Lengths of anchors as shares of LENGTH: first that of all windows, then those of windows whose names are too hot.
ANCHORS = (0.2, 0.6, 0.9, 1.0)
#: Bytes of pieces that are joined to one text; a name with more gets longer anchors.
TEXT_BYTES = 250_000
#: Windows of a hot piece that are put together at a time, and bytes that a task makes before it passes them on.
GATHER, FLUSH = 1 << 16, 8_000_000
_ODD = np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(0xD1B54A32D192ED03, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of a text's substrings from running sums; powers are kept for the next text."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray):
        cls = type(self)
        if len(b) > len(cls.up):
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(b) + len(b) // 2, f)])) for f in (_ODD, _INVERSE))
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * cls.up[: len(b)], out=self.sums[1:])

    def of(self, starts, ends) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _least(h: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum of each run of `width` values, or what else `of` keeps of two."""
    span = 1
    while span * 2 <= width:
        h = of(h[:-span], h[span:])
        span *= 2
    return of(h[: len(h) - (width - span)], h[width - span :])


def pieces(data: bytes, length: int = LENGTH, anchor: int = int(ANCHORS[0] * LENGTH), contents: bool = True, twice: bool = True) -> tuple[np.ndarray, ...]:
    """Names, content hashes, first windows and numbers of windows of a text's pieces, and whether they hold the named string twice.

    With whole windows as anchors each window is a piece. contents, twice: whether these are worked out."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    h = _Hashes(b)
    # the running sums give the hash of every anchor-length string
    strings = _mix((h.sums[anchor:] - h.sums[:-anchor]) * h.down[: n - anchor + 1])
    name = _least(strings, length - anchor + 1)
    starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if anchor < length else np.arange(len(name))
    counts = np.diff(np.append(starts, len(name)))
    content = _mix(h.of(starts, starts + counts + length - 1) + counts.astype(np.uint64) * _ODD) if contents else np.zeros(len(starts), np.uint64)
    held = np.ones(len(starts), np.int64)
    if twice:
        # strings that name a window: those as large as the largest name of the windows that hold them
        width = length - anchor + 1
        around = np.zeros(width - 1, np.uint64)
        naming = np.flatnonzero(strings == _least(np.concatenate([around, name, around]), width, np.maximum))
        named = strings[naming]
        ordered = np.sort(named)
        if (ordered[1:] == ordered[:-1]).any():
            low, high = np.searchsorted(naming, starts), np.searchsorted(naming, starts + counts + width - 1)
            spans = high - low
            held = np.add.reduceat(named[_ranges(low, spans)] == np.repeat(name[starts], spans), np.cumsum(spans) - spans, dtype=np.int64)
    return name[starts], content, starts, counts, held > 1


def suffix_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the texts, each ended by a mark of its own, in the order of their first `depth` bytes at least.

    Marks sort before bytes and by text. Returns the joined bytes (marks are 0), the order, and each text's first place.
    Prefix doubling: each round sorts what is still tied by twice as many bytes."""
    lengths = np.array([len(t) + 1 for t in texts])
    firsts = np.cumsum(lengths) - lengths
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n, k = len(joined), 7
    text_of = np.repeat(np.arange(len(texts)), lengths)
    last = np.repeat(firsts + lengths - 1, lengths)  # the place of the own mark
    places = np.arange(n)
    value = joined.astype(np.int64) + 1
    value[firsts + lengths - 1] = 0
    # seven symbols in one number; nothing beyond the own mark is looked at
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= 9
        if i < n:
            key[: n - i] |= np.where(places[: n - i] + i < last[: n - i], value[i:], 0)
    order = np.argsort(key)
    at, fresh = np.arange(n), np.concatenate([[True], np.diff(key[order]) != 0])  # places in the order that are still in question
    ranks = np.empty(n, np.int64)
    while True:
        ranks[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))  # a group's rank is its first place in the order
        tied = ~fresh | ~np.append(fresh[1:], True)
        at = at[tied]
        if k >= depth or not len(at):
            return joined, order, firsts
        # groups keep their places; within them suffixes go by what follows, those that have ended first and by text
        suffixes = order[at]
        ahead = suffixes + k
        second = np.where(ahead <= last[suffixes], ranks[np.minimum(ahead, n - 1)] + len(texts), text_of[suffixes])
        key = ranks[suffixes] * (n + len(texts) + 1) + second
        by = np.argsort(key)
        order[at] = suffixes[by]
        fresh = np.concatenate([[True], np.diff(key[by]) != 0])
        k *= 2


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def expand(last_column: np.ndarray, has_symbol: np.ndarray, marks: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of the interval that each row is in after backward extension to `length` symbols.

    last_column: the Burrows-Wheeler transform; has_symbol: False where a text begins. The first `marks` rows are the marks.
    `fresh` holds the boundaries whose common prefix has just been found to be one shorter than the level. Rows of one interval
    with the same symbol before them are neighbours one symbol further on, and a boundary comes between those that are now
    apart. Of the parts of a split interval the first keeps the interval's number and only the others' rows are looked at:
    of any two parts one at least is among them."""
    n = len(last_column)
    symbol_rows = np.flatnonzero(has_symbol)
    symbol_rows = symbol_rows[np.argsort(last_column[symbol_rows], kind="stable")]
    # the row one symbol further on, and the rows before and after this one with the same symbol; rows without a symbol lead nowhere
    ahead, before, after = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    ahead[symbol_rows] = np.arange(marks, n)
    column = last_column[symbol_rows]
    same = np.flatnonzero(column[1:] == column[:-1])
    before[symbol_rows[same + 1]] = symbol_rows[same]
    after[symbol_rows[same]] = symbol_rows[same + 1]
    number, used = np.zeros(n, np.int32), 1
    first, end = np.zeros(n + 1, np.int64), np.full(n + 1, n, np.int64)  # by interval number
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    fresh = np.concatenate([np.arange(1, marks + 1), marks + 1 + np.flatnonzero(column[1:] != column[:-1])])
    fresh = fresh[fresh < n]
    for _ in range(length):
        if not len(fresh):
            break
        bound[fresh] = True
        # each boundary starts a part with a number of its own, which ends at the next boundary or with the split interval
        of = number[fresh]  # equal numbers are neighbours, as fresh ascends
        last = np.append(of[1:] != of[:-1], True)
        ends = np.append(fresh[1:], n)
        ends[last] = end[of[last]]
        heads = np.append(True, last[:-1])
        end[of[heads]] = fresh[heads]
        own = np.arange(used, used + len(fresh), dtype=np.int32)
        first[used : used + len(own)], end[used : used + len(own)] = fresh, ends
        used += len(own)
        sizes = ends - fresh
        rows, of = _ranges(fresh, sizes), np.repeat(own, sizes)
        number[rows] = of
        if len(rows) * 3 > n:
            of = number[symbol_rows]
            fresh = marks + 1 + np.flatnonzero(of[1:] != of[:-1])
            fresh = fresh[~bound[fresh]]
        else:
            to = ahead[rows]
            fresh = np.concatenate([to[number[before[rows]] != of], to[number[after[rows]] != of] + 1])
            fresh = np.sort(fresh[~bound[fresh]])
            fresh = fresh[np.append(fresh[1:] != fresh[:-1], True)[: len(fresh)]]
    return first[number], end[number]


def repeats(texts: list[bytes], length: int = LENGTH, weights: list[int] | None = None) -> list[np.ndarray]:
    """For each text, whether each of its length-byte windows also starts elsewhere in these texts, of which there are so many copies."""
    joined, order, firsts = suffix_order(texts, length + 1)
    is_first = np.zeros(len(joined), bool)
    is_first[firsts] = True
    first, end = expand(joined[order - 1], ~is_first[order], len(texts), length)
    weight = np.repeat(np.ones(len(texts), np.int64) if weights is None else np.array(weights), [len(t) + 1 for t in texts])
    sums = np.concatenate([[0], np.cumsum(weight[order])])
    shared = np.zeros(len(joined), bool)
    shared[order[sums[end] - sums[first] > 1]] = True
    # suffixes of `length` bytes are in one interval where these agree, and none of them can be a mark
    return [shared[f : f + max(0, len(t) - length + 1)] for f, t in zip(firsts.tolist(), texts, strict=True)]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(first, end) of each maximal run of True, as flat pairs."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype("<i4").ravel()


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


NAMES = "name bigint, twice boolean"
PIECES = "name bigint, content bigint, file bigint, place bigint, start int, windows int"


def _names(length: int, anchor: int):
    """(text) -> NAMES of all pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pieces((t.as_py() or "").encode(), length, anchor, contents=False) for t in b.column(0)]
            name, twice = (np.concatenate([np.zeros(0, x), *[f[k] for f in found]]) for k, x in ((0, np.uint64), (4, bool)))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(twice)], ["name", "twice"])

    return run


def _all_pieces(length: int, anchor: int):
    """(file, place, text) -> PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            if not len(b):
                continue
            found = [pieces((t.as_py() or "").encode(), length, anchor, twice=False) for t in b.column(2)]
            name, content, start, count = (np.concatenate([f[k] for f in found]) for k in range(4))
            own = pa.array(np.repeat(np.arange(len(b)), [len(f[0]) for f in found]))
            columns = [name.view(np.int64), content.view(np.int64), b.column(0).take(own), b.column(1).take(own), start.astype(np.int32), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    return run


KINDS = [("name", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cut(length: int):
    """(text, asked) -> the asked pieces' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for text, asked in zip(b.column(0), b.column(1), strict=True):
                data = (text.as_py() or "").encode()
                for a in asked.as_py():
                    own = data[a["start"] : a["start"] + a["windows"] + length - 1]
                    rows.append((a["name"], a["content"], a["copies"], _digest(own), own))
                    size += len(own)
                if size > FLUSH:
                    yield _batch(KINDS, rows)
                    rows, size = [], 0
            yield _batch(KINDS, rows)

    return run


FOUND = [("name", pa.int64()), ("content", pa.int64()), ("runs", pa.binary())]


def _expand_groups(length: int, text_bytes: int):
    """(name, content, copies, data) sorted by name -> their repeated windows. Whole names are joined to texts of about text_bytes."""

    def solve(rows: list[tuple]) -> list[tuple]:
        flags = repeats([r[3] for r in rows], length, [r[2] for r in rows])
        return [(name, content, runs_of(f).tobytes()) for (name, content, *_), f in zip(rows, flags, strict=True) if f.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, at = [], 0, None
        for b in batches:
            for name, content, copies, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != at and size > text_bytes:
                    yield _batch(FOUND, solve(rows))
                    rows, size = [], 0
                at = name
                rows.append((name, content, copies, data))
                size += len(data)
        if rows:
            yield _batch(FOUND, solve(rows))

    return run


PARTS = [("name", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("data", pa.binary()), ("of_name", pa.int64()), ("of_content", pa.int64()), ("start", pa.int32())]


def _refine(length: int, anchor: int):
    """(name, content, copies, data) -> the pieces that longer anchors make of each, which know where they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for name, content, copies, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for n, c, start, windows in zip(*(x.tolist() for x in (y.view(np.int64) for y in pieces(data, length, anchor, twice=False)[:4])), strict=True):
                    rows.append((n, c, copies, data[start : start + windows + length - 1], name, content, start))
                    size += windows + length + 100
                    if size > FLUSH:
                        yield _batch(PARTS, rows)
                        rows, size = [], 0
            yield _batch(PARTS, rows)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, content, parts) -> FOUND; parts are runs of windows, each counted from its start."""
    for b in batches:
        rows = []
        for name, content, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs = np.concatenate([np.frombuffer(x["runs"], "<i4").reshape(-1, 2) + x["start"] for x in parts])
            low = int(runs.min())
            steps = np.zeros(int(runs.max()) - low + 1, np.int32)
            np.add.at(steps, runs[:, 0] - low, 1)
            np.add.at(steps, runs[:, 1] - low, -1)
            rows.append((name, content, (runs_of(np.cumsum(steps)[:-1] > 0) + low).astype("<i4").tobytes()))
        yield _batch(FOUND, rows)


RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _remove(length: int, with_kept: bool):
    """(doc_id, n_bytes, sha, text, found) -> the result. found: pieces with their repeated windows and their kinds' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, sha, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode() if text is not None else b""
                if not found:
                    rows.append((doc_id, n, 0, 0, sha if sha is not None else hashlib.sha256(data).hexdigest(), data if with_kept else None))
                    continue
                steps = np.zeros(len(data) + 1, np.int64)
                for f in found:
                    if _digest(data[f["start"] : f["start"] + f["windows"] + length - 1]) != f["digest"]:
                        raise ValueError(f"two pieces share a hash; one is in document {doc_id}: use other hash constants")
                    runs = np.frombuffer(f["runs"], "<i4").astype(np.int64) + f["start"]
                    np.add.at(steps, runs[::2], 1)
                    np.add.at(steps, runs[1::2] + length - 1, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((doc_id, n, int(gone.sum()), len(runs_of(gone)) // 2, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            yield _batch(RESULT, rows)

    return run


def _sql(schema: list) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{n} {names[t]}" for n, t in schema)


def _repeated(kinds: DataFrame, length: int, anchors: tuple[int, ...], text_bytes: int) -> DataFrame:
    """FOUND for kinds(name, content, copies, data), which are stored: those of narrow names by expansion, the others by way of longer anchors."""
    cool, rest = kinds, None
    if anchors:
        wide = kinds.groupBy("name").agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("kinds")).where(F.col("bytes") > text_bytes)
        wide = stored(wide.select("name", "kinds", F.lit(True).alias("wide")))
        if not wide.isEmpty():
            marked = join_by_key(kinds, wide, "name", "kinds")
            cool = marked.where("wide is null").drop("wide")
            parts = stored(marked.where("wide").drop("wide").mapInArrow(_refine(length, anchors[0]), _sql(PARTS)))
            # equal pieces of different kinds are one kind here
            finer = stored(parts.groupBy("name", "content").agg(F.sum("copies").alias("copies"), F.min("data").alias("data")))
            hit = _repeated(finer, length, anchors[1:], text_bytes)
            key = F.struct("name", "content").alias("piece")
            uses = parts.groupBy("name", "content").agg(F.count("*").alias("uses"))
            hit = hit.join(uses, ["name", "content"]).select(key, "uses", "runs")
            back = join_by_key(parts.select(key, "of_name", "of_content", "start"), hit, "piece", "uses").where("runs is not null")
            rest = back.select(F.col("of_name").alias("name"), F.col("of_content").alias("content"), "start", "runs")
            # first stretches of a piece, then the piece: a very long one is not gathered window by window
            some = rest.groupBy("name", "content", F.floor(F.col("start") / GATHER).alias("block")).agg(F.collect_list(F.struct("start", "runs")).alias("parts"))
            some = some.select("name", "content", "parts").mapInArrow(_gather, _sql(FOUND))
            whole = some.groupBy("name", "content").agg(F.collect_list(F.struct(F.lit(0).alias("start"), "runs")).alias("parts"))
            rest = whole.mapInArrow(_gather, _sql(FOUND))
    cool = cool.select("name", "content", "copies", "data").repartition("name").sortWithinPartitions("name")
    found = cool.mapInArrow(_expand_groups(length, text_bytes), _sql(FOUND))
    return stored(found if rest is None else found.unionByName(rest))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, anchors: tuple[float, ...] = ANCHORS, text_bytes: int = TEXT_BYTES, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, and the remaining bytes as `kept` if with_kept."""
    widths = sorted({max(1, round(a * length)) for a in anchors} | {length})
    at = ["file", "place"]
    rows = placed(docs)
    d = rows.select(*at, F.col(f"row.`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    # first the names alone, as most occur once; contents are looked at where names are left
    names = d.select("text").mapInArrow(_names(length, widths[0]), NAMES).groupBy("name").agg(F.count("*").alias("total"), F.bool_or("twice").alias("twice"))
    names = stored(names.where("total > 1 or twice").select("name", "total", F.lit(True).alias("left")))
    every = d.select(*at, "text").mapInArrow(_all_pieces(length, widths[0]), PIECES)
    left = stored(join_by_key(every, names, "name", "total").where("left").drop("left"))
    kinds = left.groupBy("name", "content").agg(F.count("*").alias("copies"), F.min(F.struct(*at, "start", "windows")).alias("at"))
    asked = kinds.groupBy("at.file", "at.place").agg(F.collect_list(F.struct("name", "content", "copies", "at.start", "at.windows")).alias("asked"))
    per = left.select(*at).distinct().withColumn("open", F.lit(True)).join(asked, at, "left")
    # texts move once; those in which nothing can repeat leave their digest and stay behind
    data = F.coalesce("text", F.lit("")).cast("binary")
    t = d.join(per, at, "left").withColumn("open", F.coalesce("open", F.lit(False)))
    needed = F.col("open") if not with_kept else F.lit(True)
    t = stored(t.select(*at, "doc_id", F.length(data).cast("bigint").alias("n_bytes"), F.when(~F.col("open"), F.sha2(data, 256)).alias("sha"), F.when(needed, F.coalesce("text", F.lit(""))).alias("text"), "asked"))
    cut = stored(t.where("asked is not null").select("text", "asked").mapInArrow(_cut(length), _sql(KINDS)))
    found = _repeated(cut.drop("digest"), length, tuple(widths[1:]), text_bytes)
    key = F.struct("name", "content").alias("piece")
    weights = found.join(cut.select("name", "content", "copies", "digest"), ["name", "content"]).select(key, "copies", "digest", "runs")
    hits = join_by_key(left.select(key, *at, "start", "windows"), weights, "piece", "copies").where("runs is not null")
    per_text = hits.groupBy(*at).agg(F.collect_list(F.struct("start", "windows", "digest", "runs")).alias("found"))
    last = t.join(per_text, at, "left").select("doc_id", "n_bytes", "sha", "text", "found")
    out = last.mapInArrow(_remove(length, with_kept), _sql(RESULT))
    return out if with_kept else out.drop("kept")


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
