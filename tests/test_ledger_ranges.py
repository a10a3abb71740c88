import random

import pytest

from tiza.operators import ledger


def plain(rows):
    out = {}
    for o, _, d in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        b, a, r = out.get(o, (0, 0, 0))
        out[o] = (b + d, a + 1, r) if b + d >= 0 else (b, a, r + 1)
    return out


def got(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: (r.balance, r.accepted, r.rejected) for r in rows}


@pytest.mark.parametrize("amounts", [(10, -15), (100, -1, -2, -3), (1, -1), (7, -5, -11, -400)])
def test_a_hot_owner_spans_ranges(spark, amounts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", None, *"abcdef"]) if rng.random() < 0.7 else "hot", rng.randrange(500), rng.choice(amounts)) for _ in range(3000)]
    rows += [("hot", 250, amounts[1])] * 400  # equal entries, more than a range holds
    df = spark.createDataFrame(rows, "owner string, t int, delta int").repartition(5)
    assert got(ledger.consume(df, "owner", ["t"], range_rows=150)) == got(ledger.consume(df, "owner", ["t"])) == plain(rows)


def test_ranges_are_tasks_of_bounded_size(spark):
    df = spark.createDataFrame([("hot", i, 3 if i % 2 else -4) for i in range(4000)], "owner string, t int, delta int").selectExpr("*")
    dealt = df.repartitionByRange(40, "owner", "t", "delta").rdd.glom().map(len).collect()
    assert len(dealt) == 40 and max(dealt) < 300
    assert got(ledger.consume(df, "owner", ["t"], range_rows=100)) == plain([tuple(r) for r in df.collect()])


def test_few_turns(spark, monkeypatch):
    """Far from zero no debit is rejected, so the first pieces hold for any start."""
    turns = []
    folded = ledger._folded
    monkeypatch.setattr(ledger, "_folded", lambda *a: turns.append(1) or folded(*a))
    rows = [("hot", 0, 10**6)] + [("hot", i, -3) for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "owner string, t int, delta int")
    assert got(ledger.consume(df, "owner", ["t"], range_rows=100)) == {"hot": (10**6 - 3 * 2999, 3000, 0)}
    assert len(turns) == 2  # the small owners' and one for all ranges


def test_no_entries(spark):
    df = spark.createDataFrame([], "owner string, t int, delta int")
    assert got(ledger.consume(df, "owner", ["t"])) == {}
