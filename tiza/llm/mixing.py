"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With a source's share a / Q of Q slots, its block k is released at slot
floor(k Q / a) and due before slot ceil((k + 1) Q / a); in each slot, the released block with the earliest deadline goes
next, of equal ones that of the larger share, then of the first name. This keeps every source within less than one block of
its share of the slots so far. The schedule repeats after Q slots, so Q slots are worked out once, by a fold in one row, and
every block's slot follows from its number by arithmetic: no task sees a whole source or the whole schedule.

Q is SLOTS, or FINE slots for each source if that is more. Sources of equal share have their blocks released and due
together and take turns, so the fold keeps a counter for each distinct share, of which there are fewer than sqrt(2 Q). A share
differs from Q times its weight by less than two slots and a FINEth of it.

No row is dropped: a source that ends early leaves its later slots empty, and the others go on in their proportions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiza.llm.common import join_by_key, placed, stored, table

#: Slots in a period at least, and for each source at least; shares are whole numbers of slots.
SLOTS, FINE = 1000, 20
#: Rows in a block.
BLOCK = 16
#: Rows that one task numbers within a source.
PIECE = 2_000
#: Sources whose plan, some 200 bytes each, is sent to every task; with more, only heavy ones' is, and the others are joined.
MOST_SENT = 100_000
NO_SOURCE = ""


def temperature_shares(counts: DataFrame, exponent: float = 0.7, slots: int = SLOTS) -> DataFrame:
    """(src, a): whole shares of `slots` in proportion to n ** exponent, 1 at least, from counts(src, n) of at most `slots` sources.

    Largest remainders get what rounding leaves; ties go by name."""
    c = counts.select("src", F.pow(F.col("n").cast("double"), exponent).alias("w"))
    total = c.agg(F.count("*").alias("S"), F.aggregate(F.array_sort(F.collect_list(F.struct("src", "w"))), F.lit(0.0), lambda t, x: t + x["w"]).alias("T"))  # in the order of names, so that it is always the same
    c = c.join(F.broadcast(total))  # one row
    c = c.withColumn("x", F.round(F.col("w") / F.col("T") * (slots - F.col("S")), 9)).withColumn("fl", F.floor("x"))
    # a list of the sources, as the fold over the schedule holds it as well
    ranked = c.agg(F.array_sort(F.collect_list(F.struct((-(F.col("x") - F.col("fl"))).alias("o"), "src", "fl"))).alias("r"), (slots - F.max("S") - F.sum("fl")).alias("left"))
    return ranked.select(F.posexplode("r").alias("i", "r"), "left").select("r.src", (1 + F.col("r.fl") + (F.col("i") < F.col("left")).cast("long")).alias("a"))


def schedule(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(src, a, places): the slots of one period that each source gets, from shares(src, a) that add up to `slots`.

    A single row holds the shares and the period; the fold takes `slots` times the number of distinct shares. What it has worked
    out is kept in runs of about sqrt(slots), so that appending to it stays cheap."""
    q = F.lit(slots).cast("long")
    classes = shares.groupBy("a").agg(F.array_sort(F.collect_list("src")).alias("names"))
    one = classes.agg(F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("o"), "a", F.size("names").cast("long").alias("m"), "names"))).alias("s"))
    run = math.isqrt(max(slots - 1, 0)) + 1

    def slot(acc: Column, t: Column) -> Column:
        # n-th block of a class: the (n // m)-th one of its (n % m)-th source
        jobs = F.transform(F.arrays_zip(acc["n"].alias("n"), F.col("s").alias("s")), lambda x, i: F.struct(
            F.floor((F.floor(x["n"] / x["s"]["m"]) * q + q + x["s"]["a"] - 1) / x["s"]["a"]).alias("due"), i.alias("i"), F.floor(F.floor(x["n"] / x["s"]["m"]) * q / x["s"]["a"]).alias("from")))
        best = F.array(F.array_min(F.filter(jobs, lambda j: j["from"] <= t))["i"])
        return F.get(F.transform(best, lambda b: F.struct(F.transform(acc["n"], lambda n, i: F.when(i == b, n + 1).otherwise(n)).alias("n"), F.concat(acc["o"], F.array(b)).alias("o"))), F.lit(0))

    def stretch(acc: Column, r: Column) -> Column:
        none = F.array().cast("array<int>")
        inner = F.aggregate(F.sequence(r * run, F.least(r * run + run, q) - 1), F.struct(acc["n"].alias("n"), none.alias("o")), slot)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["n"].alias("n"), F.concat(acc["o"], F.array(x["o"])).alias("o"))), F.lit(0))

    zero = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("n"), F.array().cast("array<array<int>>").alias("o"))
    order = F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit((slots - 1) // run).cast("long")), zero, stretch, lambda acc: acc["o"]))
    each = one.where(F.size("s") > 0).select("s", order.alias("o")).select("o", F.posexplode("s").alias("i", "x"))
    own = F.filter(F.transform("o", lambda b, t: F.when(b == F.col("i"), t).otherwise(-1)), lambda t: t >= 0)
    each = each.select("x", own.alias("own")).select("x.a", "x.m", "own", F.posexplode("x.names").alias("j", "src"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("a") - 1), lambda k: F.get("own", (k * F.col("m") + F.col("j")).cast("int")))
    return each.select("src", "a", places.alias("places"))


def _plan(counts: DataFrame, slots: int, exponent: float = 0.7) -> tuple[DataFrame, int]:
    """(src, a, places) from counts(src, n), and the period: a source's places among its slots."""
    period = max(slots, FINE * counts.count())
    return schedule(temperature_shares(counts, exponent, period), period), period


def _cut(rows: DataFrame, counts: DataFrame, sources: int, piece: int) -> DataFrame:
    """rows(src, row, key, tie) with `piece`: parts of each source, in the order of key and tie, of about so many rows; counts(src, n).

    The key is a uniform hash of the id, whose leading digits cut each source. Where a piece is crowded because many rows share an id or have
    none, those rows are cut again by the tie, a hash of the row and its place."""
    wide = counts.select("src", "n", F.least(F.lit(2**30), F.ceil(F.col("n") / piece)).alias("pieces"))
    cut = _with(rows, wide, sources, ["pieces"]).withColumn("piece", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("pieces") / 2**32)).drop("pieces")
    crowded = stored(cut.groupBy("src", "piece").agg(F.count("*").alias("c")).where(F.col("c") > 4 * piece))
    zone, part = F.lit(0), F.lit(0)
    if not crowded.isEmpty():
        hot = cut.join(_small(crowded), ["src", "piece"], "left_semi").groupBy("src", "piece", "key").agg(F.count("*").alias("c")).where(F.col("c") > piece)
        # a list of at most c / piece keys for each crowded piece
        hot = hot.groupBy("src", "piece").agg(F.sort_array(F.collect_list(F.struct("key", F.ceil(F.col("c") / piece).alias("parts")))).alias("hot"))
        cut = cut.join(_small(stored(hot)), ["src", "piece"], "left")
        own = F.get(F.filter("hot", lambda h: h["key"] == F.col("key")), F.lit(0))
        # rows between hot keys, and those of each hot key, are zones of their own
        zone = F.coalesce(2 * F.size(F.filter("hot", lambda h: h["key"] < F.col("key"))) + F.when(own.isNotNull(), 1).otherwise(0), F.lit(0))
        part = F.coalesce(F.floor((F.col("tie") / 2.0**64 + 0.5) * own["parts"]), F.lit(0)).cast("int")
    return cut.withColumn("piece", F.struct("piece", zone.alias("zone"), part.alias("part"))).drop("hot")


def _numbered(rows: DataFrame, counts: DataFrame, sources: int, piece: int) -> DataFrame:
    """rows(src, row, key, tie) plus `at`, each row's number within its source in the order of key and tie; counts(src, n).

    Pieces are numbered by different tasks, however large a source is; counts of the pieces before give each its first number."""
    cut = _cut(rows, counts, sources, piece)
    sizes = cut.groupBy("src", "piece").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("src").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over a row for each piece
    first = sizes.select(F.col("src").alias("s2"), F.col("piece").alias("p2"), before.alias("before"))
    inner = F.row_number().over(W.partitionBy("src", "piece").orderBy("key", "tie"))
    out = cut.withColumn("inner", inner)
    return out.join(first, (out["src"] == first["s2"]) & (out["piece"] == first["p2"])).select("src", "row", (F.col("inner") - 1 + F.col("before")).alias("at"))


def _small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, to be sent to every task if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _with(rows: DataFrame, values: DataFrame, sources: int, names: list[str]) -> DataFrame:
    """rows(src, ...) with the columns `names` of values(src, n, names...): sent to every task if their number allows it, else joined without a hot task."""
    if sources <= MOST_SENT:
        return rows.join(F.broadcast(values.select("src", *names)), "src", "left")
    return join_by_key(rows, values.select("src", "n", *names), "src", "n")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, slots: int = SLOTS, block: int = BLOCK, piece: int = PIECE, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, src, slot, offset): every row of docs with its slot and its place in that slot's block.

    weights: whole shares of `slots` by source; without it shares follow the counts to the power 0.7, of `slots` or FINE for each
    source. A null source is a source of its own, named ''. Rows of a source go in the order of md5(doc_id), a null one as an
    empty text; rows of equal doc_id by a hash of their columns and place. Sources missing in weights raise an error."""
    text = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    r = placed(docs).select(F.coalesce(F.col(f"row.`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("src"), "row", F.md5(text).alias("key"), F.xxhash64("row", "file", "place").alias("tie"))
    counts = stored(r.groupBy("src").agg(F.count("*").alias("n")))
    sources = counts.count()
    if weights is None:
        plan, period = _plan(counts, slots)
    else:
        if sum(weights.values()) != slots or min(weights.values()) < 1:
            raise ValueError(f"weights are whole numbers from 1 that add up to {slots}")
        plan, period = schedule(docs.sparkSession.createDataFrame(sorted(weights.items()), "src string, a bigint"), slots), slots
    numbered = _numbered(r, counts, sources, piece)
    out = _with(numbered, stored(plan).join(counts, "src"), sources, ["a", "places"])
    b = F.floor(F.col("at") / block)
    known = F.when(F.col("a").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), F.col("src"))).cast("bigint")).otherwise(F.col("a"))
    slot = F.floor(b / known) * period + F.get("places", (b % F.col("a")).cast("int"))
    return out.select("row", "src", slot.alias("slot"), (F.col("at") % block).alias("offset"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns unchanged and no row missing, in mixing order: range-partitioned and sorted by slot, so the files written keep it."""
    return mix(docs, **options).orderBy("slot", "offset").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("row.doc_id", "row.source", "slot", "offset")


ORACLE = f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
x AS (SELECT src, count(*) OVER () AS S, round(pow(n::DOUBLE, 0.7) / (sum(pow(n::DOUBLE, 0.7)) OVER ()) * ({SLOTS} - count(*) OVER ()), 9) AS x FROM c),
a AS (SELECT src, (1 + floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, src) <= {SLOTS} - S - sum(floor(x)) OVER ())::INT)::BIGINT AS a FROM x),
l AS (SELECT list(a ORDER BY a DESC, src) AS a, list(src ORDER BY a DESC, src) AS s FROM a),
step AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda v: 0::BIGINT) AS k, 0::BIGINT AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(k, lambda v, i: v + (i = p)::BIGINT), p FROM (
    SELECT t, k, list_min(list_transform(list_filter(range(1, len(a) + 1), lambda i: k[i] * {SLOTS} // a[i] <= t),
      lambda i: {{'due': ((k[i] + 1) * {SLOTS} + a[i] - 1) // a[i], 'i': i}})).i AS p FROM step, l WHERE t < {SLOTS})),
places AS (SELECT s[pick] AS src, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM step, l WHERE t > 0),
d AS (SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR)) - 1 AS num FROM documents)
SELECT doc_id, source, (num // {BLOCK} // a * {SLOTS} + place)::BIGINT AS slot, (num % {BLOCK})::BIGINT AS "offset"
FROM d JOIN a USING (src) JOIN places ON places.src = d.src AND nth = num // {BLOCK} % a"""
