"""Index joins against plain comparisons of all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiza.operators import fuzzy_join, names, omr


def dice(a, b):
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2.0 * sum((x & y).values()) / (len(a) + len(b) - 2)


def nested_loops(df):
    return [x for x in ("NestedLoop", "Cartesian") if x in df._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize(("alphabet", "k"), [("ab ", 3), ("abcdefgh", 3), ("abc é", 1), ("abcd", 5)])
def test_top_names_equal_all_pairs(spark, monkeypatch, alphabet, k):
    monkeypatch.setattr(names, "FIRST", 2)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])))
    roll = [(i // 2, word()) for i in range(90)]
    texts = {word() for _ in range(60)} | {n for _, n in roll[:10]}
    want = {t: list(dict.fromkeys(n for _, _, n in sorted((-dice(t, n), p, n) for p, n in roll)[:k])) for t in texts}
    out = names.top_names(spark.createDataFrame([(t,) for t in texts] * 2, "text string"), spark.createDataFrame(roll, "pos int, name string"), k)
    got = out.collect()
    assert len(got) == 2 * len(texts) and {r.text: r.suggestions for r in got} == want and not nested_loops(out)
    assert names.top_names(spark.createDataFrame([(None,)], "text string"), spark.createDataFrame(roll, "pos int, name string")).first().suggestions is None


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("on", [True, False])
def test_items_equal_all_pairs(spark, compat, on):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aB1 ") for _ in range(rng.choice([0, 1, 1, 2, 3, 6])))
    items = [(rng.randrange(3), i, word(), rng.randrange(5)) for i in range(25)] + [(1, 99, None, 3)]
    asked = [(rng.randrange(4), word()) for _ in range(80)] + [(1, None)]
    want = []
    for e, q in asked:
        fits = [] if q is None else [(0 if not compat and q.strip().upper() == i.strip().upper() else 1, p, i, m) for x, p, i, m in items if i is not None and (x == e or not on) and (q.strip().upper() in i.strip().upper() or i.strip().upper() in q.strip().upper())]
        best = min(fits, default=None)
        want.append((e, q, best[2] if best else None, best[3] if best else 1))
    out = fuzzy_join.match_items(spark.createDataFrame(asked, "e int, question string"), spark.createDataFrame(items, "e int, pos int, id string, max_score int").drop(*([] if on else ["e"])), ["e"] if on else [], compat)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and not nested_loops(out)


def fold(ys, tolerance=15.0):
    rows = []
    for y in sorted(ys):
        row = next((r for r in rows if abs(r[0] - y) < tolerance), None)
        rows.append([y]) if row is None else row.append(y)
    return rows


MARK = "array<struct<state:string,confidence:double,polygon:array<struct<x:double,y:double>>>>"


def page(ys):
    return [("selected", 0.9, [(float(i % 7), float(y)), (1.0, 1.0), (2.0, 2.0)]) for i, y in enumerate(ys)]


def test_mark_rows_equal_first_fit(spark):
    rng = random.Random(2)
    pages = [[rng.choice([rng.uniform(0, 200), rng.randrange(0, 200, 15), rng.randrange(200)]) for _ in range(rng.choice([0, 1, 5, 60]))] for _ in range(60)]
    df = spark.createDataFrame([(i, page(p)) for i, p in enumerate(pages)], f"p int, marks {MARK}")
    got = {r.p: [sorted(m.polygon[0].y for m in row) for row in r.rows] for r in df.select("p", omr.mark_rows(F.col("marks")).alias("rows")).collect()}
    assert got == {i: fold(map(float, p)) for i, p in enumerate(pages)}


def test_a_page_of_many_marks(spark):
    import time

    for gap in (0.01, 20.0):  # few long rows, and a row for each mark
        df = spark.createDataFrame([(page([i * gap for i in range(20_000)]),)], f"marks {MARK}").cache()
        df.count()
        began = time.time()
        assert df.select(F.size(omr.mark_rows(F.col("marks")))).first()[0] == len(fold([i * gap for i in range(20_000)])) if gap < 1 else 20_000
        assert time.time() - began < 20
