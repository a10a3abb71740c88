"""Hard negatives by inverted lists: rows of other labels whose score with an anchor lies in a window below a positive's score.

Rows lie in the lists of a k-means; a list's stored centroid and radius bound its scores with an anchor: by Cauchy-Schwarz,
a.x = a.c + a.(x - c) is at most a.c + |a| radius and at least a.c - |a| radius. An anchor visits the lists by falling upper
bound, a few at first and eight times as many in each further round, leaves out those whose scores can't lie in a window of
its own, and stops where the bound falls strictly below its kth score so far: rows beyond can't even tie. What comes out is
therefore exact, whatever the lists are like.

Anchors travel in blocks and lists in parts; a task scores one block with one part by a matrix product and passes on no more
than k rows for each window of an anchor."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiza.llm.common import stored, table

#: Rows from which the lists' centres are learned, at most about so many; all rows are then put into lists.
SAMPLE = 20_000
#: Lists at most; the centres, a row each, are sent to every task.
MOST_LISTS = 512
#: Rows of a list that are scored as one part, anchors that travel together, and those of them that are scored at a time.
PART, BLOCK, AT_ONCE = 4096, 16_384, 512
#: Lists that an anchor visits in the first round, and how many times as many in each further one.
FIRST, GROWTH = 8, 8
#: An anchor's positives, and the negatives of each.
POSITIVES, NEGATIVES = 5, 3


def quantised(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, q): each component as floor(scale * x), x as double.

    Rows with a null id, label or vector or any component that is null or not finite take no part. Of rows with an equal id
    the least by label and components stays. An empty vector has the score 0 with any other; a shorter one counts as ending in zeros."""
    r = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double") * scale).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    r = r.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    exact = F.forall("v", lambda x: F.abs(x) < 2.0**53)
    q = F.when(exact, F.transform("v", lambda x: F.floor(x).cast("double"))).otherwise(F.raise_error(F.lit("a component is too large for exact scores")))
    return r.groupBy("id").agg(F.min(F.struct("label", q.alias("q"))).alias("r")).select("id", "r.*")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` numbers; shorter lists end in zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(c.offsets.to_numpy())
    flat = c.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    for i, row in enumerate(np.split(flat, np.cumsum(n)[:-1]) if len(n) else []):
        out[i, : len(row)] = row
    return out


def longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy().reshape(len(c), -1) if len(c) else np.zeros((0, 0), np.int64)


def centres(rows: DataFrame, seed: int = 1) -> np.ndarray:
    """Centres of a k-means over about SAMPLE rows, chosen by a hash of the id; about half the root of the rows' number, at most MOST_LISTS."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    k = min(MOST_LISTS, round(math.sqrt(n) / 2))
    if k < 2 or not width:
        return np.zeros((1, width))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE)
    padded = F.concat("q", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("q")))
    model = KMeans(k=k, maxIter=8, initMode="random", seed=seed, featuresCol="v").fit(some.select(array_to_vector(padded).alias("v")).repartition(8))
    return np.array(model.clusterCenters())


def in_lists(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """rows(id, label, q) with the number of the nearest centre and the distance to it."""
    half = (c * c).sum(1) / 2

    def assign(batches):
        for b in batches:
            x = matrix(b.column("q"), c.shape[1])
            near = (half - x @ c.T).argmin(1)
            far = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*b.schema.names, "list", "distance"])

    return rows.mapInArrow(assign, "id bigint, label bigint, q array<double>, list int, distance double")


def best_of(anchors: dict, rows: dict, width: int, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Places of anchors, windows and rows, and their scores: the k best rows of each anchor's windows, ties by smaller id.

    anchors: id, label, q and the windows' ends lo and hi (a column each); rows: id, label, q by rising id. same: rows of the
    anchor's label, but not itself; else rows of other labels."""
    a, x = anchors["q"], rows["q"]
    most = math.sqrt((a * a).sum(1).max(initial=0)) * math.sqrt((x * x).sum(1).max(initial=0))
    if most >= 2.0**62:
        raise ValueError("a score does not fit a long")
    # sums of whole numbers are exact below 2^53 in doubles
    s = (a @ x.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ x.astype(np.int64).T
    alike = anchors["label"][:, None] == rows["label"]
    fits = alike & (anchors["id"][:, None] != rows["id"]) if same else ~alike
    none = np.iinfo(np.int64).min
    found = []
    for w in range(anchors["lo"].shape[1]):
        left = np.where(fits & (s >= anchors["lo"][:, w, None]) & (s <= anchors["hi"][:, w, None]), s, none)
        here = np.flatnonzero(left.max(1, initial=none) > none)
        left = left[here]
        for _ in range(k):
            if not len(here):
                break
            at = left.argmax(1)  # the first of equal ones has the smallest id
            top = left[np.arange(len(here)), at]
            on = top > none
            found.append((here[on], np.full(on.sum(), w), at[on], top[on]))
            left[np.arange(len(here)), at] = none
            here, left = here[on], left[on]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


_LONGS, _FULL = "array<bigint>", np.iinfo(np.int64).max


def search(anchors: DataFrame, lists: DataFrame, c: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int, same: bool) -> DataFrame:
    """(id, window, score, other): the k best rows of each window of anchors(id, label, q, lo, hi), ties by smaller id.

    lo and hi are arrays: the least and greatest score of each window."""
    width, number = c.shape[1], len(c)
    blocks = max(1, -(-anchors.count() // BLOCK))
    parts = np.maximum(1, -(-size // PART))
    first, found = 0, None
    while first < number:
        last = number if first + FIRST >= number or first and first * GROWTH >= number else max(FIRST, first * GROWTH)

        def visits(batches, first=first, last=last):
            for b in batches:
                a = matrix(b.column("q"), width)
                reach = np.sqrt((a * a).sum(1))[:, None] * radius
                slack = 1e-9 * reach + 1e-6
                mid = a @ c.T
                high, low = mid + reach + slack, mid - reach - slack
                fits = np.zeros(mid.shape, bool)
                lo, hi = (longs(b.column(n)) for n in ("lo", "hi"))
                for w in range(lo.shape[1]):
                    fits |= (high >= lo[:, w, None]) & (low <= hi[:, w, None])
                place = np.empty(mid.shape, np.int64)
                np.put_along_axis(place, np.argsort(-high, axis=1, kind="stable"), np.arange(number)[None, :], 1)
                i, j = np.nonzero(fits & (place >= first) & (place < last) & (size > 0))
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(parts[j].astype(np.int32)), *[x.take(pa.array(i)) for x in b.columns]], ["list", "parts", *b.schema.names])

        current = anchors if found is None else _raised(anchors, found, k)
        current = current.select("id", "label", "q", "lo", "hi")
        go = current.mapInArrow(visits, f"list int, parts int, id bigint, label bigint, q array<double>, lo {_LONGS}, hi {_LONGS}")
        go = go.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        held = lists
        if found is not None:  # of the lists only those are sent on that some anchor still visits
            asked = [r["list"] for r in go.select("list").distinct().collect()]  # at most a row for each list
            if not asked:
                break
            held = lists.where(F.col("list").isin(asked))
        by = F.create_map(*[F.lit(int(x)) for pair in enumerate(parts) for x in pair]) if (parts > 1).any() else F.lit(None)
        many = F.coalesce(by[F.col("list")], F.lit(1)) if (parts > 1).any() else F.lit(1)
        there = held.select("list", F.pmod(F.xxhash64("id"), many).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "label", "q")

        def score(_, left, right):
            if not len(left) or not len(right):
                return pa.table({"id": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
            right = right.sort_by("id")
            a, r = ({"id": x.column("id").to_numpy(), "label": x.column("label").to_numpy(), "q": matrix(x.column("q"), width)} for x in (left, right))
            a |= {x: longs(left.column(x)) for x in ("lo", "hi")}
            found = []
            for at in range(0, len(a["id"]), AT_ONCE):
                i, w, j, s = best_of({x: v[at : at + AT_ONCE] for x, v in a.items()}, r, width, k, same)
                found.append((a["id"][i + at], w.astype(np.int32), s, r["id"][j]))
            return pa.table(dict(zip(("id", "window", "score", "other"), map(np.concatenate, zip(*found)))))

        key = ["list", "part", "block"]
        new = go.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(score, "id bigint, window int, score bigint, other bigint")
        new = new if found is None else found.unionByName(new)
        found = stored(_best(new, k))
        first = last
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    at = W.partitionBy("id", "window").orderBy(F.desc("score"), "other")
    return found.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= k).drop("_at")


def _raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """anchors whose windows with k rows begin at the kth of their scores: an equal score may still win by its id."""
    kth = found.groupBy("id", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    kth = kth.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # as many as windows
    lo = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w), x)))
    return anchors.join(kth, "id", "left").withColumn("lo", F.when(F.col("kth").isNull(), F.col("lo")).otherwise(lo)).drop("kth")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(id, label, q) as of quantised().

    Positives are the first other rows of an anchor's label; negatives of each the first rows of other labels whose score is
    from `low` to `high` per cent of the positive's. Higher scores come first, ties by smaller id. A positive with a negative
    score has no negatives, as its window is empty."""
    rows = stored(rows)
    c = centres(rows)
    lists = stored(in_lists(rows, c))
    radius, size = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in lists.groupBy("list").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r["list"]], size[r["list"]] = r["far"], r["n"]
    ends = lambda x: F.array(F.lit(int(x))).cast(_LONGS)
    anchors = rows.where(is_anchor).select("id", "label", "q", ends(-_FULL).alias("lo"), ends(_FULL).alias("hi"))
    own = search(anchors, lists, c, radius, size, positives, True)
    # ceil(share * score / 100) without leaving the range of long; the greatest score is score - ceil((100 - high) score / 100)
    up = lambda share: F.expr(f"(score div 100) * {share} + (score % 100 * {share} + 99) div 100")
    own = own.where("score >= 0").withColumns({"lo": up(low), "hi": F.col("score") - up(100 - high)})
    ranked = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "other", "score", "lo", "hi"))).alias("p"))  # as many as positives
    padded = lambda n, rest: F.concat(F.transform("p", lambda x: x[n]), F.array_repeat(F.lit(rest).cast("long"), F.lit(positives) - F.size("p")))
    windows = stored(ranked.join(anchors.select("id", "label", "q"), "id").select("id", "label", "q", padded("lo", _FULL).alias("lo"), padded("hi", -_FULL).alias("hi"), F.transform("p", lambda x: F.struct(x["other"].alias("id"), x["score"].alias("score"))).alias("positives")))
    found = search(windows.drop("positives"), lists, c, radius, size, negatives, False)
    at = W.partitionBy("id", "window").orderBy(F.desc("score"), "other")
    out = found.withColumn("rank", F.row_number().over(at)).join(windows.select("id", "positives"), "id")
    positive = F.get("positives", F.col("window"))
    return out.select(F.col("id").alias("anchor_id"), positive["id"].alias("positive_id"), "rank", F.col("other").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose vec_id is divisible by 50; a label changes first where 7 divides the vec_id. An empty table gives no rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    e = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine(quantised(e), F.col("id") % 50 == 0)


ORACLE = f"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score FROM e AS a JOIN e AS b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
