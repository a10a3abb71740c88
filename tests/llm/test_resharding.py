import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import edge_docs
from tiza.llm import resharding as rs


def cheapest(sizes, capacities, cost):
    """The least cost over all ways to deal out units."""
    if not sizes:
        return 0
    best = float("inf")
    n = len(capacities)
    for split in itertools.product(range(sizes[0] + 1), repeat=n - 1):
        row = [*split, sizes[0] - sum(split)]
        if row[-1] >= 0 and all(x <= c for x, c in zip(row, capacities)):
            best = min(best, sum(x * c for x, c in zip(row, cost[0])) + cheapest(sizes[1:], [c - x for x, c in zip(row, capacities)], cost[1:]))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    m, n = rng.randint(1, 3), rng.randint(1, 3)
    sizes = [rng.randint(0, 4) for _ in range(m)]
    room = [sum(sizes) // n + rng.randint(0, 3) for _ in range(n)]
    room[0] += max(0, sum(sizes) - sum(room))
    cost = np.array([[rng.randint(0, 5) for _ in range(n)] for _ in range(m)])
    flow = rs.transfers(sizes, room, cost)
    assert flow.sum(1).tolist() == sizes and (flow.sum(0) <= room).all() and (flow >= 0).all()
    assert (flow * cost).sum() == cheapest(sizes, room, cost.tolist())


def test_flow_moves_only_what_is_over():
    sizes, room = [900, 10, 50, 40, 500], [300, 300, 300, 600]
    flow = rs.transfers(sizes, room)
    assert sum(sizes) - np.trace(flow[:4, :4]) == sum(max(0, s - c) for s, c in zip(sizes, [*room, 0]))
    with pytest.raises(ValueError):
        rs.transfers([5], [4])
    assert rs.transfers([], [3]).size == 0 and rs.transfers([0, 0], [0]).sum() == 0


def contents(rows):
    return sorted((str(r.row.doc_id), zlib.crc32((r.row.text or "").encode())) for r in rows.collect())


def test_kept_files_stay_and_all_rows_come_once(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('é', cast(id % 97 as int))").alias("text")).repartition(12, "doc_id")
    rs.write_shards(docs, F.expr("cast(pow(doc_id % 100 / 100.0, 3) * 4 as int)"), f"{tmp_path}/old")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")}
    made = rs.reshard(spark, f"file://{tmp_path}/old", 5, f"{tmp_path}/new")
    rows = rs.resharded_rows(spark, made).cache()
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")} == before
    assert contents(rows) == contents(spark.read.parquet(f"{tmp_path}/old"))
    by = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("u"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.sum("size").alias("size")).collect()
    assert len(by) == 5 and all((r.n, r.n - 1, 0) == (r.u, r.z, r.a) for r in by)
    assert max(r["size"] for r in by) - min(r["size"] for r in by) <= 200
    assert made.kept and 0 < len(made.split) <= (made.flow > 0).sum()
    stayed = rows.select("row.doc_id", "shard").join(spark.read.parquet(f"{tmp_path}/old").select("row.doc_id", F.col("shard").alias("was"), "size"), "doc_id").where("shard = was").agg(F.sum("size")).first()[0]
    assert abs(stayed - np.trace(made.flow[:, :4])) <= 400  # the flow's amounts, but for rows at the cuts
    # no room elsewhere and none needed: nothing moves
    sizes = [r["s"] for r in spark.read.parquet(f"{tmp_path}/old").groupBy("shard").agg(F.sum("size").alias("s")).orderBy("shard").collect()]
    same = rs.reshard(spark, f"file://{tmp_path}/old", sizes, f"{tmp_path}/none")
    assert len(same.kept) == len(before) and not same.written and not same.split


def test_whole_table(spark, sf_dir):
    rows = rs.op13_resharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(rows.doc_id) == sorted(docs.index) and set(rows.law) == {"bytes"} and set(rows.shard) == set(range(8)) and rows.grown_shard.isna().all()
    for r in rows.itertuples():
        t = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_edge_rows(spark, tmp_path):
    docs = edge_docs(spark).withColumns({"shard": F.lit("s"), "size": F.lit(None).cast("int"), "to": F.lit(1), "file": F.lit(2)})
    rs.write_shards(docs, F.lit(0), f"{tmp_path}/old")
    rows = rs.resharded_rows(spark, rs.reshard(spark, f"file://{tmp_path}/old", 3, f"{tmp_path}/new"))
    assert rows.select("row.*").columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "", r.file) for r in rows.select("row.*").collect()) == sorted((str(r.doc_id), r.text or "", r.file) for r in docs.collect())
    assert rows.where("size = 1").count() == 2
    schema = rs.write_shards(docs.where("false"), F.lit(0), f"{tmp_path}/none")
    assert rs.resharded_rows(spark, rs.reshard(spark, f"file://{tmp_path}/none", 3, f"{tmp_path}/n2", schema=schema)).count() == 0
