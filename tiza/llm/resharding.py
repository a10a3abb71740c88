"""Resharding by minimum-cost flow: from the sizes of old shards and the capacities of new ones to the cheapest transfers, then to files.

The flow runs from old to new shards; a byte that stays in its shard costs nothing, any other one (or what a given cost matrix
says). Its amounts are served by blocks, the files of a shard: whole files stay or go, and only a file in which one amount ends
and the next begins is split by documents. Files that stay are not touched; files that go, and split ones, are read and
written anew. The flow's graph has a node for each shard, so it is solved in the driver; documents never pass through it, only
the list of files, which a scan needs there anyway."""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tiza.llm.common import packed, shared_dir, table

#: Shards before and after in the query.
OLD, NEW = 6, 8
#: Rows of a file at most: what splits a file looks at their sizes in one task.
FILE_ROWS = 200_000


def transfers(sizes: list[int], capacities: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Amounts from each old shard to each new one: all sizes are placed, no capacity is exceeded, and the cost is least.

    cost: of a unit from shard i to j, not negative; without it 0 in place and 1 elsewhere. The flow is increased along cheapest paths of
    the remaining network until nothing is left; each path is found by relaxing all arcs until no distance falls."""
    if sum(capacities) < sum(sizes):
        raise ValueError(f"capacities of {sum(capacities)} for sizes of {sum(sizes)}")
    m, n = len(sizes), len(capacities)
    price = np.asarray(1 - np.eye(m, n) if cost is None else cost, float)
    left, room, flow = np.array(sizes, np.int64), np.array(capacities, np.int64), np.zeros((m, n), np.int64)
    while left.any():
        at, to = np.where(left > 0, 0.0, np.inf), np.full(n, np.inf)
        came, back = np.full(n, -1), np.full(m, -1)  # the old shard before a new one on the path, and the other way round
        while True:
            onward, returned = at[:, None] + price, np.where(flow > 0, to - price, np.inf)
            better = onward.min(0, initial=np.inf) < to
            to[better], came[better] = onward.min(0)[better], onward.argmin(0)[better]
            again = returned.min(1, initial=np.inf) < at
            at[again], back[again] = returned.min(1)[again], returned.argmin(1)[again]
            if not better.any() and not again.any():
                break
        j = int(np.where(room > 0, to, np.inf).argmin())
        path = [(int(came[j]), j)]
        while back[path[-1][0]] >= 0:
            i = path[-1][0]
            path.append((int(came[back[i]]), int(back[i])))
        source = path[-1][0]
        undone = [(path[k][0], path[k + 1][1]) for k in range(len(path) - 1)]
        amount = min(left[source], room[j], *(flow[i] for i in undone))
        for i in path:
            flow[i] += amount
        for i in undone:
            flow[i] -= amount
        left[source] -= amount
        room[j] -= amount
    return flow


def write_shards(docs: DataFrame, shard: Column, folder: str, text: str = "text") -> StructType:
    """docs as files below folder/shard=<n>: each row whole as `row`, with its size (UTF-8 bytes of the text and one) and the text's crc32.

    A null text counts as empty. Columns of any names may follow, as rows are packed; equal and repeated rows stay as they are.
    Returns the files' schema, with which an empty folder can be read as well."""
    shards = packed(docs.withColumn("_shard", shard.cast("int"))).select("row", F.coalesce(F.col(f"row.{text}"), F.lit("")).alias("t"))
    out = shards.select(F.col("row._shard").alias("shard"), F.col("row").dropFields("_shard").alias("row"), (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("crc"))
    out.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(folder)
    return out.schema


class Resharded(NamedTuple):
    """What a resharding made: files that stay, the folder of new ones, amounts of the flow, and the files that were split."""

    folder: str
    kept: list[str]
    written: str
    flow: np.ndarray
    split: list[str]
    schema: StructType | None = None


def _located(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "shard", "row", "size", "crc")


def _parts(amounts: dict[str, dict[int, int]]):
    """Rows of a split file to shards: the largest first, each to the shard that lacks most, so that what remains amiss is about the smallest row."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "at"], ascending=[False, True])
        lack = dict(amounts[rows["file"].iloc[0]])
        to = []
        for size in rows["size"]:
            j = max(lack, key=lambda j: (lack[j], -j))
            lack[j] -= size
            to.append(j)
        return rows[["file", "at"]].assign(to=to)

    return deal


def reshard(spark: SparkSession, folder: str, capacities: list[int] | int, written: str, cost: np.ndarray | None = None, schema: StructType | None = None) -> Resharded:
    """Moves the shards of `folder` (see write_shards) to new ones of these capacities; a number means as many of equal size.

    Files of `folder` are not changed; what moves, and the rest of a split file, is written below `written`."""
    reader = lambda: spark.read.schema(schema) if schema else spark.read
    rows = _located(reader().parquet(folder))
    files = sorted((r["shard"], r["file"], r["size"]) for r in rows.groupBy("shard", "file").agg(F.sum("size").alias("size")).collect())  # a row for each file
    sizes = [0] * (1 + max((f[0] for f in files), default=-1))
    for shard, _, size in files:
        sizes[shard] += size
    total = sum(sizes)
    if isinstance(capacities, int):
        capacities = [total * (j + 1) // capacities - total * j // capacities for j in range(capacities)]
    flow = transfers(sizes, capacities, cost)
    kept, gone, split = [], {}, {}
    for i in range(len(sizes)):
        order = sorted((j for j in range(len(capacities)) if flow[i][j]), key=lambda j: (j != i, j))
        ends = list(accumulate(int(flow[i][j]) for j in order))
        start = 0
        for _, name, size in (f for f in files if f[0] == i):
            shares = {j: min(end, start + size) - max(end - int(flow[i][j]), start) for j, end in zip(order, ends)}
            shares = {j: x for j, x in shares.items() if x > 0}
            start += size
            if len(shares) > 1:
                split[name] = shares
            elif i in shares:
                kept.append(name)
            else:
                gone.setdefault(*shares, []).append(name)
    read = lambda names: _located(reader().option("basePath", folder).parquet(*names))
    new = [read(names).withColumn("shard", F.lit(j)).drop("file", "at") for j, names in sorted(gone.items())]
    if split:
        of = read([*split])
        to = of.select("file", "at", "size").groupBy("file").applyInPandas(_parts(split), "file string, at bigint, to int")
        new.append(of.join(to, ["file", "at"]).withColumn("shard", F.col("to")).drop("file", "at", "to"))
    if new:
        moved = new[0]
        for x in new[1:]:
            moved = moved.unionByName(x)
        moved.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(written)
    return Resharded(folder, kept, written if new else "", flow, [*split], schema)


def resharded_rows(spark: SparkSession, made: Resharded) -> DataFrame:
    """(shard, slot, row, size, crc): all rows of the new shards, numbered in each from 0 without gaps.

    A slot is the number of the shard's rows in earlier files and the row's number in its own, so no rows are sorted or sent."""
    reader = lambda: spark.read.schema(made.schema) if made.schema else spark.read
    parts = [_located(reader().option("basePath", made.folder).parquet(*made.kept))] if made.kept else []
    parts += [_located(reader().parquet(made.written))] if made.written else []
    rows = parts[0] if parts else _located(reader().parquet(made.folder))
    for x in parts[1:]:
        rows = rows.unionByName(x)
    counts = rows.groupBy("shard", "file").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # over a row for each file
    first = counts.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(first, "file").select(F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).alias("slot"), "row", "size", "crc")


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which lie in OLD shards by a hash of their source, moved to NEW shards of equal bytes by the fewest bytes.

    An empty table gives no rows; a missing source counts as an empty one, a missing doc_id stays missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    folder = shared_dir(spark)
    schema = write_shards(docs, F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD)), f"{folder}/old")
    rows = resharded_rows(spark, reshard(spark, f"{folder}/old", NEW, f"{folder}/new", schema=schema))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
