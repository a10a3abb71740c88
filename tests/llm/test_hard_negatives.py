import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tiza.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, q int, list string"


def brute_force(rows, anchors, positives=5, negatives=3):
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, la, a in rows:
        if not anchors(i):
            continue
        scored = sorted((-score(a, b), j, lb) for j, lb, b in rows if j != i)
        for p, j, lb in [x for x in scored if x[2] == la][:positives]:
            fit = [(n, m) for n, m, ln in scored if ln != la and 50 * -p <= 100 * -n <= 95 * -p]
            out |= {(i, j, k + 1, m, -p, -n) for k, (n, m) in enumerate(fit[:negatives])}
    return out


def found(df):
    return [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]


def whole(rows):
    sound = [(i, la, [math.floor(256 * float(np.float32(x))) for x in v]) for v, i, la in ((r[1], r[0], r[2]) for r in rows) if None not in (i, la, v) and None not in v and all(map(math.isfinite, v))]
    best = {}
    for i, la, q in sound:
        best[i] = min(best.get(i, (la, q)), (la, q))
    return [(i, la, q) for i, (la, q) in best.items()]


def test_equals_brute_force_over_many_lists(spark, monkeypatch):
    """Tight groups, ties, a third of all rows equal; many small parts, blocks and rounds."""
    monkeypatch.setattr(hn, "PART", 7)
    monkeypatch.setattr(hn, "BLOCK", 5)
    monkeypatch.setattr(hn, "AT_ONCE", 3)
    monkeypatch.setattr(hn, "FIRST", 2)
    monkeypatch.setattr(hn, "GROWTH", 2)
    rng = random.Random(3)
    mids = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(mids)], rng.randrange(3), "x", 1, "y") for i in range(400)]
    rows += [(400 + i, mids[0], i % 2, "x", 1, "y") for i in range(200)]
    got = found(hn.mine(hn.quantised(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 10 == 0))
    assert len(got) == len(set(got)) and set(got) == brute_force(whole(rows), lambda i: i % 10 == 0)


def test_whole_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.ORACLE})").fetchall()
    got = found(hn.op12_hard_negatives(spark, sf_dir))
    assert sorted(got) == sorted(want) and len(got) > 100


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.7, 0.1], 2), (2, [0.7, 0.1], 2), (3, [0.6, 9.0], 2), (4, [0.7, 0.0], 2), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [], 1), (11, [0.75], 3), (12, [0.1, 0.1], 1), (12, [0.1, 0.1], 0)]
    rows = [(*r, "x", 1, "y") for r in rows]
    got = found(hn.mine(hn.quantised(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 2 == 0))
    padded = [(i, la, q + [0] * (2 - len(q))) for i, la, q in whole(rows)]
    assert set(got) == brute_force(padded, lambda i: i % 2 == 0) and got
    assert found(hn.mine(hn.quantised(spark.createDataFrame([], SCHEMA)), F.col("id") % 2 == 0)) == []
    one = spark.createDataFrame([(0, [1.0], 1, "x", 1, "y")], SCHEMA)
    assert found(hn.mine(hn.quantised(one), F.col("id") % 2 == 0)) == []


@pytest.mark.parametrize("large", [1, 2**27])
def test_scores_are_exact(large):
    rng = np.random.default_rng(1)
    q = rng.integers(-9, 9, (40, 3)).astype(float) * large
    own = {"id": np.arange(40), "label": np.arange(40) % 2, "q": q}
    ends = np.iinfo(np.int64).max
    a = own | {"lo": np.full((40, 1), -ends), "hi": np.full((40, 1), ends)}
    i, _, j, s = hn.best_of(a, own, 3, 4, True)
    exact = [[sum(int(x) * int(y) for x, y in zip(q[m], q[n])) for n in range(40)] for m in range(40)]
    for m in range(40):
        want = sorted((-exact[m][n], n) for n in range(40) if n != m and n % 2 == m % 2)[:4]
        assert [(-x, y) for x, y in zip(s[i == m].tolist(), j[i == m].tolist())] == want
    with pytest.raises(ValueError):
        hn.best_of(a | {"q": q * 2.0**30}, own | {"q": q * 2.0**30}, 3, 4, True)


def test_pruned_lists_hold_nothing(spark, monkeypatch):
    """Far lists are left out: the search ends before the last round where no bound reaches a kth score."""
    monkeypatch.setattr(hn, "GROWTH", 2)
    rounds = []
    best = hn._best
    monkeypatch.setattr(hn, "_best", lambda *a: rounds.append(1) or best(*a))
    rng = np.random.default_rng(2)
    mids = rng.normal(size=(20, 8)) * 10
    rows = [(i, (mids[i % 20] + rng.normal(size=8) * 0.01).tolist(), i % 3, "x", 1, "y") for i in range(1200)]
    r = hn.quantised(spark.createDataFrame(rows, SCHEMA))
    c = hn.centres(r)
    lists = hn.in_lists(r, c)
    assert len(c) > 8 and lists.agg(F.max("distance")).first()[0] < 256 * 60
    got = found(hn.mine(r, F.col("id") % 50 == 0))
    assert set(got) == brute_force(whole(rows), lambda i: i % 50 == 0) and 2 <= len(rounds) < 4
