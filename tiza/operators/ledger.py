"""Credit ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from tiza.operators.dedupe import first_wins
from tiza.operators.lineage import checkpointed


def once_per_operation(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first entry of each operation; repeats of it change nothing."""
    return first_wins(entries, keys, order)


def new_orders(orders: DataFrame, paid: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders that aren't among the paid ones."""
    return orders.join(paid.select(key), key, "left_anti")


def balances(entries: DataFrame, owner: str = "owner", delta: str = "delta") -> DataFrame:
    return entries.groupBy(owner).agg(F.sum(delta).alias("balance"))


def running_balance(entries: DataFrame, owner: str, order: list[str], delta: str = "delta") -> DataFrame:
    """entries with the owner's balance after each: one owner's entries meet in a task, which may spill them."""
    return entries.withColumn("balance", F.sum(delta).over(W.partitionBy(owner).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


#: Entries of an owner that one row may hold; an owner with more is cut into ranges of about so many.
RANGE_ROWS = 100_000


def consume(entries: DataFrame, owner: str, order: list[str], delta: str = "delta", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(owner, balance, accepted, rejected): debits that would make the balance negative are rejected, in order.

    A debit's outcome depends on all before it. An owner's entries are folded in one row; one with more than range_rows is cut
    into ranges of its sorted log, which tasks fold side by side, see _consume_ranges. Entries that are equal in order are taken
    by their amounts."""
    e = entries.select(owner, *order, F.col(delta).cast("long").alias("_delta"))
    large = e.groupBy(owner).agg(F.count("*").alias("_n")).where(F.col("_n") > range_rows).withColumnRenamed(owner, "_owner")
    large = checkpointed(large)
    count = large.agg(F.sum("_n")).first()[0] or 0
    if not count:
        return _folded(e.groupBy(owner).agg(_log(order).alias("_log")), F.lit(0)).select(owner, "_r.balance", "_r.accepted", "_r.rejected")
    of_large = F.col(owner).eqNullSafe(F.col("_owner"))
    small = e.join(large, of_large, "left_anti").groupBy(owner).agg(_log(order).alias("_log"))
    small = _folded(small, F.lit(0)).select(owner, "_r.balance", "_r.accepted", "_r.rejected")
    return small.unionByName(_consume_ranges(e.join(large, of_large, "left_semi"), owner, order, -(-count // range_rows)))


def _log(order: list[str]) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, "_delta"))), lambda e: e["_delta"])


def _folded(logs: DataFrame, start: Column) -> DataFrame:
    """logs(_log, ...) with _r: the balance after all entries from a balance at the start, how many were accepted and rejected,
    and by how much the start could be less or more without any other outcome."""
    one, most = F.lit(1).cast("long"), F.lit(2**62)

    def step(a: Column, d: Column) -> Column:
        after = a["balance"] + d
        ok = after >= 0
        return F.struct(
            F.when(ok, after).otherwise(a["balance"]).alias("balance"),
            F.when(ok, a["accepted"] + one).otherwise(a["accepted"]).alias("accepted"),
            F.when(ok, a["rejected"]).otherwise(a["rejected"] + one).alias("rejected"),
            F.when(ok & (d < 0), F.least(a["less"], after)).otherwise(a["less"]).alias("less"),
            F.when(ok, a["more"]).otherwise(F.least(a["more"], -after - one)).alias("more"),
        )

    zero = F.lit(0).cast("long")
    first = F.struct(start.cast("long").alias("balance"), zero.alias("accepted"), zero.alias("rejected"), most.alias("less"), most.alias("more"))
    return logs.withColumn("_r", F.aggregate("_log", first, step))


def _consume_ranges(entries: DataFrame, owner: str, order: list[str], ranges: int) -> DataFrame:
    """As consume(), for owners whose entries are too many for a row.

    A range of a log is a function from the balance before it to the one after it: piece by piece a constant is added, as the
    same debits are accepted all over a piece. Pieces are worked out where they are needed: all ranges are folded at once from
    guessed balances, which gives each the piece around the guess; then the balances are followed through the ranges, and those
    met outside their known pieces are folded again, again at once. A turn settles the first of these at least, mostly all.
    Only a few numbers for each range pass through the driver."""
    spark, session_type = entries.sparkSession, entries.schema[owner]
    # equal entries are told apart by a number, as any order of them gives the same
    dealt = entries.withColumn("_tie", F.rand(7)).repartitionByRange(ranges, owner, *order, "_delta", "_tie").withColumn("_range", F.spark_partition_id())
    logs = dealt.groupBy(owner, "_range").agg(_log(order).alias("_log"), F.sum("_delta").alias("_sum"))
    logs = checkpointed(logs.withColumn("_no", F.monotonically_increasing_id()))
    by_owner: dict = {}
    for r in sorted(logs.select("_no", owner, "_range", "_sum").collect(), key=lambda r: r["_range"]):
        by_owner.setdefault(r[owner], []).append((r["_no"], r["_sum"]))
    pieces: dict[int, list] = {}

    def follow(ranges: list) -> tuple[list, tuple]:
        """The ranges to fold, with their starts, and the outcome if there are none."""
        balance, accepted, rejected, missing = 0, 0, 0, []
        for no, total in ranges:
            known = next((p for p in pieces.get(no, []) if p[0] <= balance <= p[1]), None)
            if known is None:
                missing.append((no, balance))
                near = min(pieces.get(no, []), key=lambda p: max(p[0] - balance, balance - p[1]), default=None)
                balance = max(0, balance + (near[2] if near else total))
            else:
                balance, accepted, rejected = balance + known[2], accepted + known[3], rejected + known[4]
        return missing, (balance, accepted, rejected)

    while missing := [m for ranges in by_owner.values() for m in follow(ranges)[0]]:
        starts = spark.createDataFrame(missing, "_no bigint, _start bigint")
        for r in _folded(logs.join(starts, "_no"), F.col("_start")).select("_no", "_start", "_r.*").collect():
            piece = (r["_start"] - r["less"], r["_start"] + r["more"], r["balance"] - r["_start"], r["accepted"], r["rejected"])
            pieces.setdefault(r["_no"], []).append(piece)
    out = [(k, *follow(v)[1]) for k, v in by_owner.items()]
    schema = StructType([session_type, *[StructField(n, LongType()) for n in ("balance", "accepted", "rejected")]])
    return spark.createDataFrame(out, schema)


def grant_once(entries: DataFrame, owner: str, order: list[str], amount: int = 10) -> DataFrame:
    """A grant at each owner's first entry."""
    return first_wins(entries, [owner], order).withColumn("delta", F.lit(amount).cast("long"))


def blocked(balance: Column) -> Column:
    return F.coalesce(balance, F.lit(0)) <= 0
