"""N-gram Jaccard self-join by chosen paths.

Texts become sets of 5-word shingles; equal sets form one class. Each set is embedded as minimum-hash values, one token per
coordinate, so two sets share each token with probability equal to their Jaccard similarity. A run splits all sets
recursively: at each node of its tree a few coordinates, 1 / threshold on average, are drawn by a hash of the path so far, and
a set goes on to one child for each, named by its token there. Similar sets stay together in some leaf with a probability that
independent runs, as many as the threshold and the target recall ask for (runs_for), raise to that target. The first DEPTH levels need no other set, so they are computed
where the set lies; only buckets that are still too large are split further, level by level. They are split in AGAIN
independent ways, as deeper trees alone would lose more pairs.

Leaves are compared by brute force with exact similarities. Leaves with the same members count once. A pair that shares
several leaves belongs to the first of them, so it is counted once without any shuffle of pairs. A leaf that no split makes
smaller, as with thousands of near copies, is cut into chunks, and each pair of chunks is a unit of work of its own: no
pair leaves its task, only each set's counts and its group's smallest member do.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; a text of one to four words has one
shingle, its words. Texts are taken whole, however long: a long one is a set of many shingles. Null texts and texts without words are in no pair, and each is a class of its own. Rows are told apart by
their places in files (common.placed), so ids may repeat or be null, and copies of a row are linked like other copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import checkpointed, join_by_key, placed, releasing, table

THRESHOLD, WORDS = 0.8, 5
COORDINATES, DEPTH = 128, 3
#: Least probability that a pair at the threshold is found.
TARGET_RECALL = 0.9999
#: Buckets larger than SPLIT sets are split further, for at most MORE_LEVELS levels.
SPLIT, MORE_LEVELS = 2000, 3
#: Independent ways in which such a bucket is split, so that pairs in it reach the target recall too.
AGAIN = 3
#: Sets in a chunk, and shingles of a set that count as one: longer sets make smaller chunks. A unit compares one or two chunks.
CHUNK, LONG = 512, 1000
#: Rows in an Arrow batch of texts or shingles.
BATCH = 256
MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_COEFFICIENTS = [np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, f)])) for f in (_ODD, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()
_RANDOM = np.random.default_rng(11)
_A = _RANDOM.integers(0, 1 << 64, (COORDINATES, 1), np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 64, (COORDINATES, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, from running sums over its bytes."""
    b = np.frombuffer((text or "").lower().encode(), np.uint8)
    edge = np.diff(np.concatenate([[False], _WORD_BYTE[b], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    n = min(WORDS, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _COEFFICIENTS[k]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """The set's token at each coordinate: 16 bits of its smallest hash there."""
    low = np.full((COORDINATES, 1), MASK, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, _mix(_A * s[i : i + 2048] + _B).min(1, keepdims=True))
    return (_mix(low[:, 0]) >> np.uint64(48)).astype("<u2")


def children(path: int, tokens: list[int], threshold: float = THRESHOLD) -> list[int]:
    """The nodes below path that a set with these tokens goes to: one for each coordinate drawn there, 1 / threshold draws on average."""
    r = _mix_int(path)
    draws = int(1 / threshold)
    if (r >> 8) & 0xFFFF < 0x10000 * (1 / threshold - draws):
        draws += 1
    drawn = {r & 127, *[(_mix_int(r + j) if j > 1 else r >> 32) & 127 for j in range(1, draws)]}
    return [_mix_int(path ^ (((i << 16 | tokens[i]) * 0x9E3779B97F4A7C15) & MASK)) for i in drawn]


def leaves(sig: np.ndarray, runs: int, depth: int = DEPTH, threshold: float = THRESHOLD) -> list[int]:
    tokens, out = sig.tolist(), []
    for run in range(runs):
        level = [_mix_int(run + 1)]
        for _ in range(depth):
            level = [c for p in level for c in children(p, tokens, threshold)]
        out += level
    return sorted(set(out))


def again(path: int, ways: int = AGAIN) -> list[int]:
    """The nodes that stand for path where a bucket too large is first split: itself, and others that draw their coordinates independently."""
    return [path, *(_mix_int(path ^ _mix_int(MASK - way)) for way in range(1, ways))]


def miss_rate(similarity: float, runs: int = 1, depth: int = DEPTH, more_levels: int = 0, ways: int = AGAIN, threshold: float = THRESHOLD) -> float:
    """Probability that no run keeps two sets of this similarity together for `depth` levels, and then in any of `ways` splits for `more_levels`."""
    draws = int(1 / threshold)
    further, gone = 1 / threshold - draws, 0.0
    for level in range(more_levels + depth):
        if level == more_levels:
            gone = gone**ways
        lost = 1 - similarity + similarity * gone
        gone = (1 - further) * lost**draws + further * lost ** (draws + 1)
    return gone**runs


def shared_miss_rate(similarity: float, runs: int = 1, **tree) -> float:
    """miss_rate where all runs draw from the same COORDINATES: the mean over the number of coordinates at which the two sets agree."""
    n = COORDINATES
    return sum(comb(n, i) * similarity**i * (1 - similarity) ** (n - i) * miss_rate(i / n, **tree) ** runs for i in range(n + 1))


@cache
def runs_for(threshold: float, target: float = TARGET_RECALL) -> int:
    """Runs after which a pair at the threshold has been found with the target probability, wherever its buckets are split."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    runs = 1
    while shared_miss_rate(threshold, runs, more_levels=MORE_LEVELS, threshold=threshold) > 1 - target:
        runs += 1
    return runs


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SETS = "file bigint, place bigint, doc_id bigint, key binary, size bigint, sig binary, paths array<bigint>"


def _sets(runs: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sigs, paths = [], [], [], []
            for text in b.column(3):
                s = shingles(text.as_py())
                sizes.append(len(s))
                if len(s):
                    sig = signature(s)
                    keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(sig.tobytes())
                    paths.append([_signed(p) for p in leaves(sig, runs, threshold=threshold)])
                else:
                    keys.append(None), sigs.append(None), paths.append(None)
            arrays = [*b.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "place", "doc_id", "key", "size", "sig", "paths"])

    return run


def _deeper(ways: int, threshold: float = THRESHOLD):
    """(path, key, size, sig) -> the same sets one level further down, in so many independent ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, k, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.frombuffer(s, "<u2").tolist()
                out += [(_signed(c), k, n, s) for q in again(p & MASK, ways) for c in children(q, tokens, threshold)]
            columns = list(zip(*out, strict=True)) or ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["path", "key", "size", "sig"])

    return run


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what is made of one at a time stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_docs, buckets, text) -> the same with the text's shingles."""
    for b in _sliced(batches):
        own = [shingles(t.as_py()).tobytes() for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own, pa.binary())], ["key", "n_docs", "buckets", "shingles"])


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right."""
    if len(left) * len(right) <= 30:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    all_of = np.concatenate(sets)  # narrow blocks of columns keep the matrices small, however long the sets are
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(all_of, return_inverse=True, return_counts=True)
    several = counts > 1  # a shingle of one set alone is in no intersection
    number = np.cumsum(several) - 1
    on = several[inverse]
    rows, cols = owner[on], number[inverse[on]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, int(several.sum()), 4096):
        a, z = np.searchsorted(cols, [at, at + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[rows[a:z], cols[a:z] - at] = 1
        out += m[left] @ m[right].T
    return out


COUNTS = "key binary, root binary, links bigint, text_links bigint"


def compare(rows: list[dict], path: int, one: int, other: int, threshold: float) -> list[tuple]:
    """(key, smallest key of its group here, linked documents, linked sets) of each set with a link that belongs to this unit."""
    seen: dict[bytes, dict] = {r["key"]: r for r in rows}
    rows = [seen[k] for k in sorted(seen)]
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    chunk = np.array([r["chunk"] for r in rows])
    left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == other)
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets])
    small, large = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    ask = small >= threshold * large
    ask &= left[:, None] < right[None] if one == other else True
    # a pair belongs to the first of the leaves that both sets are in
    earlier = [np.array([p for p in r["paths"] if p < path], np.int64) for r in rows]
    if ask.any():
        ask &= _shared(earlier, left, right) == 0
    if not ask.any():
        return []
    both = _shared(sets, left, right)
    linked = ask & (both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-6)
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    weight = np.array([r["n_docs"] for r in rows])
    n = len(rows)
    docs = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    root = np.arange(n)
    while True:  # rows are sorted by key, so the smallest number is the smallest key
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(rows[k]["key"], rows[root[k]]["key"], int(docs[k]), int(texts[k])) for k in np.flatnonzero(texts)]


def _units(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, done = None, [], []

        def flush() -> None:
            if len(rows) > 1:
                done.extend(compare(rows, *unit, threshold))

        for b in _sliced(batches):
            for r in b.to_pylist():
                if (u := (r["path"], r["one"], r["other"])) != unit:
                    flush()
                    unit, rows = u, []
                rows.append(r)
            if len(done) > 1000:
                yield _counts(done)
                done = []
        flush()
        yield _counts(done)

    def _counts(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "root", "links", "text_links"])

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's component, from edges(u, v).

    Each round takes the least label of a vertex and its neighbours, then that label's own label, so distances halve;
    each round's labels are checkpointed. Rounds end when nothing changes."""
    pairs = edges.where("u <> v")
    both = checkpointed(pairs.select("u", "v").union(pairs.select("v", "u")).distinct())
    # the smallest vertex of a large group is a hub: joins serve vertices with many rows by broadcast
    labels = checkpointed(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("label"), F.count("*").alias("n")).select("v", "n", F.least("v", "label").alias("label")))
    for _ in range(max_rounds):
        near = join_by_key(both, labels.select(F.col("v").alias("u"), "n", "label"), "u", "n").groupBy("v").agg(F.min("label").alias("near"))
        low = labels.join(near, "v").select("v", "n", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = low.groupBy("low").agg(F.count("*").alias("m")).join(labels.select(F.col("v").alias("low"), F.col("label").alias("next")), "low")
        after = checkpointed(join_by_key(low, jump, "low", "m").select("v", "n", "old", F.least("low", F.coalesce("next", "low")).alias("label")))
        labels = after.select("v", "n", "label")
        if after.where("label <> old").isEmpty():
            return labels.select("v", "label")
    raise RuntimeError("components did not settle")


def _in_batches(spark: SparkSession, rows: int, made: Callable[[], DataFrame]) -> DataFrame:
    """What made() works out at once, with at most so many rows in an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        return made()
    finally:
        spark.conf.set(name, before)


def _sizes(rows: DataFrame) -> DataFrame:
    """(path, n, weight, x, y) from rows(path, key, size): each bucket's number of sets, their weight in sets of LONG shingles, and two hashes of its members, which can't overflow."""
    h = lambda seed: F.bit_xor(F.xxhash64("key", F.lit(seed)))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / LONG))).alias("weight"), h(1).alias("x"), h(2).alias("y"))


def _of(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows(path, key, size) of these buckets(path, n, ...), with their columns. A family of copies shares its paths: heavy ones are looked up in a broadcast, so no task takes a whole path."""
    found = join_by_key(rows.select("path", "key", "size"), buckets.select("path", "n", F.struct(*buckets.columns).alias("of")), "path", "n")
    return found.where("of is not null").select("key", "size", "of.*")


def _buckets(sets: DataFrame, split: int, more_levels: int, threshold: float) -> DataFrame:
    """(path, weight, key): the members of every leaf of two or more sets, leaves with the same members once."""
    rows = sets.select(F.explode("paths").alias("path"), "key", "size")
    done = None
    for level in range(more_levels + 1):
        sizes = checkpointed(_sizes(rows).where("n > 1"))
        last = level == more_levels
        leaf = sizes if last else sizes.where(F.col("n") <= split)
        leaf = leaf.groupBy("n", "x", "y").agg(F.min("path").alias("path"), F.max("weight").alias("weight")).select("path", "n", "weight")
        members = _of(rows, leaf).select("path", "weight", "key")
        done = members if done is None else done.unionByName(members)
        large = sizes.where(F.col("n") > split).select("path", "n")
        if last or large.isEmpty():
            return done
        deeper = _of(rows, large).join(sets.select("key", "sig"), "key").select("path", "key", "size", "sig")
        rows = checkpointed(deeper.mapInArrow(releasing(_deeper(1 if level else AGAIN, threshold)), "path bigint, key binary, size bigint, sig binary").select("path", "key", "size").distinct())
    return done


def _groups(docs: DataFrame, threshold: float, runs: int | None, split: int, more_levels: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs with their places, members (file, place, doc_id, key) and classes (key, rep, n_docs, label, links, text_links)."""
    rows = placed(docs)
    d = rows.select("file", "place", F.col(f"row.`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    members = _in_batches(docs.sparkSession, BATCH, lambda: checkpointed(d.mapInArrow(releasing(_sets(runs or runs_for(threshold), threshold)), SETS)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "place", "size", "sig", "paths"))
    classes = members.where("key is not null").groupBy("key").agg(F.count("*").alias("n_docs"), first.alias("f"))
    classes = checkpointed(classes.select("key", "n_docs", F.col("f.doc_id").alias("rep"), "f.file", "f.place", "f.size", "f.sig", "f.paths"))
    found = _buckets(classes, split, more_levels, threshold).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("path", "weight"))).alias("buckets"))
    # only the texts of sets that share a leaf are compared
    asked = classes.select("file", "place", "key", "n_docs").join(found, "key")
    texts = d.select("file", "place", "text").join(asked, ["file", "place"]).select("key", "n_docs", "buckets", "text")
    full = texts.mapInArrow(releasing(_with_shingles), "key binary, n_docs bigint, buckets array<struct<path:bigint,weight:bigint>>, shingles binary")
    each = full.select("key", "n_docs", "shingles", F.transform("buckets", lambda x: x["path"]).alias("paths"), F.explode("buckets").alias("b"))
    chunks = F.ceil(F.col("b.weight") / CHUNK).cast("int")
    each = each.select("key", "n_docs", "shingles", "paths", "b.path", F.pmod(F.xxhash64("key"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("one"), F.greatest("chunk", j).alias("other")))
    units = each.select("key", "n_docs", "shingles", "paths", "path", "chunk", F.inline(pairs))
    units = units.repartition("path", "one", "other").sortWithinPartitions("path", "one", "other")
    # texts and shingles come in short batches: a long one would stand both beside the Java heap and in each Python worker
    linked = _in_batches(docs.sparkSession, BATCH, lambda: checkpointed(units.mapInArrow(releasing(_units(threshold)), COUNTS)))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    labels = components(linked.select(F.col("key").alias("u"), F.col("root").alias("v")))
    out = classes.select("key", "n_docs", "rep").join(links, "key", "left").join(labels.withColumnRenamed("v", "key"), "key", "left")
    return rows, members.select("file", "place", "doc_id", "key"), checkpointed(out.withColumn("label", F.coalesce("label", "key")))


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, runs: int | None = None, split: int = SPLIT, more_levels: int = MORE_LEVELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, n_text_links) for each row of docs.

    class_id: the smallest doc_id of the rows connected by links. n_links: other rows whose set has at least the threshold's
    similarity; n_copies: those of them with the same set; n_text_links: the different sets among them. A pair at the threshold
    is found with probability TARGET_RECALL, unless `runs` sets the number of runs."""
    _, members, classes = _groups(docs, threshold, runs, split, more_levels, id_col, text_col)
    ids = classes.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n_docs").alias("n"))
    of_class = join_by_key(classes, ids, "label", "n").select("key", "n_docs", F.col("n_docs").alias("copies"), "class_id", "links", "text_links")
    out = join_by_key(members, of_class, "key", "n_docs")
    none = F.lit(0).cast("long")
    copies = F.coalesce(F.col("copies") - 1, none)
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", none) + copies).alias("n_links"), copies.alias("n_copies"), F.coalesce("text_links", none).alias("n_text_links")
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, runs: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are connected to an earlier one: of each group the row with the smallest doc_id stays, all its columns unchanged; of rows
    with equal ids the one that comes first in the files."""
    numbered, members, classes = _groups(docs, threshold, runs, SPLIT, MORE_LEVELS, id_col, text_col)
    of = classes.select("key", "n_docs", "label")
    rows = join_by_key(members.where("key is not null"), of, "key", "n_docs")
    at = F.struct("file", "place")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", at.alias("at"))
    first = rows.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    dropped = join_by_key(rows.select("file", "place", "label"), first, "label", "n").where(at != F.col("first.at")).select("file", "place")
    return numbered.join(dropped, ["file", "place"], "left_anti").select("row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, na.k = nb.k AS same, nb.k AS k FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM r JOIN e ON a = y),
m AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1),
s AS (SELECT a, count(*) AS links, count_if(same) AS copies, count(DISTINCT k) FILTER (NOT same) AS texts FROM e GROUP BY 1)
SELECT x AS doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(copies, 0)::BIGINT AS n_copies, coalesce(texts, 0)::BIGINT AS n_text_links
FROM m LEFT JOIN s ON a = x"""
