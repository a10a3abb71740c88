"""Names that best match a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiza.functions.similarity import dice_of, pairs
from tiza.functions.text import BLANK
from tiza.operators.lineage import checkpointed

#: Of a text's pairs the rarest ones that are looked up first.
FIRST = 3


def _pairs_by_rarity(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts(text, cut) with `rare`: those of the text's pairs that any name has, the rarest first; null without any."""
    often = names.select(F.explode("cut").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    at = texts.select("text", F.explode("cut").alias("pair")).join(often, "pair")
    rare = at.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("r"))  # as many as the text's pairs
    return texts.join(rare.select("text", F.transform("r", lambda x: x["pair"]).alias("rare")), "text", "left")


def _best(texts: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(text, r, pos, name): the k best of the names that share one of the pairs in `prefix`.

    texts(text, cut, prefix, least): names whose size alone keeps their likeness below `least` drop out at once."""
    t = texts.select("text", "cut", "prefix", "least", F.explode("prefix").alias("pair"))
    n = names.select("pos", "name", F.col("cut").alias("name_cut"), F.explode("cut").alias("pair"))
    sizes = F.size("cut") + F.size("name_cut")
    near = 2.0 * F.least(F.size("cut"), F.size("name_cut")) / sizes >= F.col("least") - 1e-9
    # a text and a name meet at each pair that they share: the rarest one counts
    once = F.col("pair") == F.get(F.array_intersect("prefix", "name_cut"), F.lit(0))
    met = t.join(n, "pair").where(near & once)
    rated = met.select("text", dice_of(F.col("text"), F.col("name"), F.col("cut"), F.col("name_cut")).alias("r"), "pos", "name")
    at = W.partitionBy("text").orderBy(F.desc("r"), "pos", "name")
    return rated.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= k).drop("_at")


def _reach(size: Column, likeness: Column) -> Column:
    """How many of a text's rarest pairs must be looked up to meet every name of at least this likeness.

    Such a name shares c >= likeness * size / (2 - likeness) pairs, so one of any size - c + 1 pairs is shared."""
    return size - F.ceil(likeness * size / (2 - likeness) - 1e-9).cast("int") + 1


def top_names(texts: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """texts(text, ...) with suggestions: of the k most similar of names(pos, name), ties by position, the distinct ones.

    An index of the names' character pairs serves the texts. Each text looks up its rarest pairs first; the kth likeness found
    bounds how many more it must look up, and which sizes of names can count. Names without a common pair have the likeness 0
    and fill what is missing by position; of those the first 2 k suffice."""
    n = checkpointed(names.select("pos", "name", pairs(F.col("name")).alias("cut")))
    t = checkpointed(_pairs_by_rarity(texts.select("text").distinct().withColumn("cut", pairs(F.col("text"))), n))
    indexed = t.where("rare is not null")
    first = _best(indexed.select("text", "cut", F.slice("rare", 1, FIRST).alias("prefix"), F.lit(0.0).alias("least")), n, k)
    kth = first.groupBy("text").agg(F.when(F.count("*") == k, F.min("r")).otherwise(0.0).alias("least"))
    further = indexed.join(kth, "text", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    more = _best(further.select("text", "cut", F.slice("rare", F.lit(1), F.greatest(_reach(F.size("cut"), F.col("least")), F.lit(0))).alias("prefix"), "least"), n, k)
    bare = lambda c: F.regexp_replace(c, f"{BLANK}+", "")
    short = t.where(F.size("cut") == 0).withColumn("b", bare(F.col("text"))).join(n.where(F.size("cut") == 0).withColumn("b", bare(F.col("name"))), "b")
    at = W.partitionBy("text").orderBy("pos", "name")
    equal = short.select("text", F.lit(1.0).alias("r"), "pos", "name").withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= k).drop("_at")
    entry = F.struct((-F.col("r")).alias("r"), "pos", "name")
    found = more.unionByName(equal).groupBy("text").agg(F.array_sort(F.collect_list(entry)).alias("_found"))  # k at most
    start = n.orderBy("pos", "name").limit(2 * k).agg(F.array_sort(F.collect_list(F.struct(F.lit(-0.0).alias("r"), "pos", "name"))).alias("s"))
    out = texts.join(found, "text", "left").withColumn("_start", start.scalar())
    have = F.coalesce("_found", F.slice("_start", 1, 0))
    fill = F.filter("_start", lambda s: ~F.exists(have, lambda f: f["pos"].eqNullSafe(s["pos"]) & f["name"].eqNullSafe(s["name"])))
    best = F.slice(F.concat(have, fill), 1, k)
    return out.select(*texts.columns, F.when(F.col("text").isNotNull(), F.array_distinct(F.transform(best, lambda s: s["name"]))).alias("suggestions"))
