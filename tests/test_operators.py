import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tiza.operators import batching, evaluate, fuzzy_join, ledger, merge, names, omr, parse, scoring
from tiza.operators.dedupe import first_of_each, first_wins, last_wins
from tiza.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_score_sheet(spark):
    df = spark.createDataFrame([(1, "SM1:1; SM2:1; VF1:2; PDesarrollo1:5; PDesarrollo2:5"), (2, "P1:3;Puntaje:3;X:0;X:abc;X;;X:12abc;X:2:9;SM1:1;SM1:1"), (3, None)], "e int, s string")
    got = [(r.e, r.pos, r.id, r.max_score, r.is_development) for r in parse.score_sheet(df, "s").orderBy("e", "pos").collect()]
    assert got[:5] == [(1, 0, "SM1", 1, False), (1, 1, "SM2", 1, False), (1, 2, "VF1", 2, False), (1, 3, "PDesarrollo1", 5, True), (1, 4, "PDesarrollo2", 5, True)]
    assert [(i, m, v) for _, _, i, m, v in got[5:]] == [("P1", 3, True), ("Puntaje", 3, False), ("X", 12, False), ("X", 2, False), ("SM1", 1, False), ("SM1", 1, False)]
    assert [r.max_score for r in parse.score_sheet_lenient(df.where("e = 2"), "s").orderBy("pos").collect()][:4] == [3, 3, 0, 0]


def test_score_sheet_in_pieces(spark):
    pieces = ["SM1:1; SM2:0", "", None, "P3:2; ; VF4:4", "SM5:5"]
    df = spark.createDataFrame([(e, i, p) for e in ("a", None) for i, p in enumerate(pieces)], "e string, i int, s string")
    whole = spark.createDataFrame([(e, "; ".join(p for p in pieces if p)) for e in ("a", None)], "e string, s string")
    columns = ["e", "pos", "id", "max_score", "is_development"]
    assert rows(parse.score_sheet_pieces(df, ["e"], "i", "s").select(columns)) == rows(parse.score_sheet(whole, "s").select(columns))


def test_a_brand_has_one_sheet(spark, sf_dir):
    got = registry.QUERIES["score_sheet_parse"](spark, sf_dir)
    assert got.groupBy("p_brand", "pos").count().where("count > 1").isEmpty()
    assert got.columns == ["p_brand", "pos", "id", "max_score", "is_development"]


def test_keys(spark):
    df = spark.createDataFrame([(1, "SM1:A; SM2:C; VF1:V; SM1:B")], "e int, k string")
    assert rows(parse.answer_key(df, ["e"], "k")) == [(1, "SM1", "B"), (1, "SM2", "C"), (1, "VF1", "V")]
    r = parse.line_key(spark.createDataFrame([("SM: a, b\nVF:v\nSM:c",), ("",)], "k string"), "k").collect()
    assert (r[0].sm, r[0].vf, r[1].sm) == (["C"], ["V"], [])


@pytest.mark.parametrize("compat", [True, False])
def test_fuzzy_match(spark, compat):
    items = spark.createDataFrame([(1, 0, "SM1", 1), (1, 1, "SM10", 3), (1, 2, "VF2", 2)], "e int, pos int, id string, max_score int")
    q = spark.createDataFrame([(1, "SM1"), (1, " sm10 "), (1, "2"), (1, "ZZ"), (2, "SM1")], "e int, question string")
    got = {(r.e, r.question): (r.item_id, r.item_max) for r in fuzzy_join.match_items(q, items, ["e"], compat).collect()}
    assert got == {(1, "SM1"): ("SM1", 1), (1, " sm10 "): ("SM1", 1) if compat else ("SM10", 3), (1, "2"): ("VF2", 2), (1, "ZZ"): (None, 1), (2, "SM1"): (None, 1)}


def test_development_points(spark):
    d = {"P1": ("2/2",), "P2": ("1/3",), "P3": ("1.5/2",), "P4": ("x",)}
    df = spark.createDataFrame([(d,), (None,)], "d map<string,struct<puntaje:string>>")
    assert rows(df.select(scoring.development_points(F.col("d")), scoring.development_points_lenient(F.col("d")))) == [(0, 0), (3, 4)]


def test_scores_and_maximum(spark):
    a = spark.createDataFrame([(1, 0, "SM1", "A", "A", 1), (1, 1, "SM1", "B", "A", 1), (1, 2, "SM2", "C", "D", 2)], "e int, pos int, question string, given string, right string, max_score int")
    assert [(r.e, r.score, r.max_score, r.pass_points, r.grade) for r in scoring.graded(scoring.closed_score(a, ["e"], ["pos"])).collect()] == [(1, 1, 3, 2, 2.5)]
    m = spark.createDataFrame([(0, 50), (14, 10), (14, 14), (0, 0)], "i int, d int").select(scoring.reconciled(F.col("i"), F.col("d")))
    assert [r[0] for r in m.collect()] == [50, 14, 14, 100]
    o = spark.createDataFrame([(["x"], ["y"]), ([], ["y"])], "o array<string>, e array<string>").select(scoring.overridden(F.col("o"), F.col("e")))
    assert [r[0] for r in o.collect()] == [["x"], ["y"]]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None), (1, 2, "c")], "k int, pos int, v string")
    assert rows(first_wins(df, ["k"], ["pos"])) == [(1, 1, "a"), (2, 1, None)]
    assert rows(last_wins(df, ["k"], ["pos"])) == [(1, 2, "c"), (2, 1, None)]
    assert rows(first_wins(first_wins(df, ["k"], ["pos"]), ["k"], ["pos"])) == rows(first_wins(df, ["k"], ["pos"]))
    assert df.select(first_of_each(F.array(F.lit(1), F.lit(2), F.lit(1)), lambda x: x)).first()[0] == [1, 2]


def fold(marks, tolerance=15):
    out = []
    for m in sorted(marks):
        for r in out:
            if abs(r[0][0] - m[0]) < tolerance:
                r.append(m)
                break
        else:
            out.append([m])
    return out


def test_mark_rows(spark):
    mark = "array<struct<state:string,confidence:double,polygon:array<struct<x:double,y:double>>>>"
    make = lambda x, y, c=0.9, s="selected": (s, c, [(float(x), float(y)), (x + 1.0, y + 0.0), (x + 1.0, y + 1.0)])
    page = [make(5, 10), make(1, 20), make(3, 24), make(1, 26, 0.86), make(1, 60), make(9, 60, 0.5), make(9, 60, 0.9, "empty"), ("selected", 0.9, [(1.0, 2.0)])]
    got = omr.read_pages(spark.createDataFrame([(1, page), (2, [])], f"p int, marks {mark}"), ["p"]).orderBy("row").collect()
    assert [(r.id, r.type, r.value, r.confidence) for r in got] == [("P1", "multiple_choice", "C", 0.9), ("P2", "multiple_choice", "A", 0.86), ("P3", "multiple_choice", "A", 0.9)]
    assert got[0].box == [1.0, 20.0, 5.0, -9.0]
    assert omr.mean_confidence(omr.read_pages(spark.createDataFrame([(2, [])], f"p int, marks {mark}"), ["p"])).first()[0] == 0.0


def test_mark_rows_of_orders_equal_a_plain_fold(spark, sf_dir):
    got = Counter((r.l_orderkey, r.l_linestatus, r.row, r.confidence) for r in registry.QUERIES["omr_rows"](spark, sf_dir).collect())
    pages = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linestatus", "l_linenumber", "l_quantity").agg((1 - F.max("l_discount")).alias("c")).collect():
        if r.c >= 0.85:
            pages.setdefault((r.l_orderkey, r.l_linestatus), []).append((r.l_quantity, float(r.l_linenumber), r.c))
    assert got == Counter((*k, i, min(m[2] for m in row)) for k, marks in pages.items() for i, row in enumerate(fold(marks)))


def test_ids_count_through_a_sheet(spark):
    mark = "array<struct<state:string,confidence:double,polygon:array<struct<x:double,y:double>>>>"
    make = lambda y: ("selected", 0.9, [(1.0, float(y)), (2.0, y + 0.0), (2.0, y + 1.0)])
    pages = [(1, 2, [make(10), make(90)]), (1, 1, [make(10), make(50), make(90)]), (1, 3, []), (1, 4, [make(5)]), (2, 1, [make(5)])]
    got = omr.read_pages(spark.createDataFrame(pages, f"sheet int, page int, marks {mark}"), ["sheet"], "page").orderBy("sheet", "page", "row").collect()
    assert [(r.sheet, r.page, r.row, r.id) for r in got] == [(1, 1, 0, "P1"), (1, 1, 1, "P2"), (1, 1, 2, "P3"), (1, 2, 0, "P4"), (1, 2, 1, "P5"), (1, 4, 0, "P6"), (2, 1, 0, "P1")]


def test_evaluation_of_an_exam(spark):
    exams = spark.createDataFrame([(1, "SM1:1; VF1:2; SM10:3; PDesarrollo1:5", "SM1:A; VF1:V; SM10:c", 51)], "exam int, sheet string, key string, declared bigint")
    answers = spark.createDataFrame(
        [(1, "ana", 0, "sm1", "A) yes", None), (1, "ana", 1, "SM1", "B", None), (1, "ana", 2, "VF1", "f", None), (1, "ana", 3, "SM10", "C", None), (1, "ana", 4, "SM77", "A", None), (9, "eva", 0, "SM1", "A", None)],
        "exam int, student string, pos int, question string, given string, mode string",
    )
    details = spark.createDataFrame([(1, "ana", "PDesarrollo1", "4/5"), (1, "luz", "PDesarrollo1", "x")], "exam int, student string, item string, points string")
    run = lambda compat: {r.student: r for r in evaluate.evaluated(exams, answers, details, compat=compat).collect()}
    # with compat SM10 gets the first match SM1, whose right answer is A
    assert tuple(run(True)["ana"])[2:] == (1, 4, 1, 0, "5/11", 3.1, 7, 11) and tuple(run(True)["luz"])[2:] == (0, 0, 0, 0, "0/11", 1.0, 7, 11)
    assert tuple(run(False)["ana"])[2:] == (4, 4, 2, 0, "8/11", 4.8, 7, 11) and set(run(False)) == {"ana", "luz"}


@pytest.mark.parametrize("first", [1, 3, 500])
def test_long_lists(spark, monkeypatch, first):
    monkeypatch.setattr(names, "FIRST", first)
    roll = [(i, f"Name{chr(97 + i)} {chr(97 + i * 7 % 26)}o") for i in range(12)]
    texts = spark.createDataFrame([("Nameb ho",), ("zz",)], "text string")
    got = {r.text: r.suggestions for r in names.top_names(texts, spark.createDataFrame(roll, "pos int, name string")).collect()}
    assert got["Nameb ho"][0] == "Nameb ho" and got["zz"] == [n for _, n in roll[:3]] and all(len(x) == 3 for x in got.values())
    items = spark.createDataFrame([(i, f"SM{i}", i) for i in range(12)], "pos int, id string, max_score int")
    q = spark.createDataFrame([("SM11",), ("SM1",), ("none",)], "question string")
    assert {r.question: r.item_id for r in fuzzy_join.match_items(q, items, compat=True).collect()} == {"SM11": "SM1", "SM1": "SM1", "none": None}
    assert fuzzy_join.match_items(q, items.limit(0)).count() == 3 and names.top_names(texts, spark.createDataFrame([], "pos int, name string")).count() == 2


def test_ledger(spark):
    e = spark.createDataFrame([("a", 1, "o1", 10), ("a", 2, "o1", 10), ("a", 3, "o2", -15), ("a", 4, "o3", -5), ("b", 1, "o4", -1)], "owner string, t int, op string, delta int")
    assert rows(ledger.consume(e, "owner", ["t"])) == [("a", 0, 4, 0), ("b", 0, 0, 1)]
    once = ledger.once_per_operation(e, ["owner", "op"], ["t"])
    assert rows(ledger.balances(once)) == [("a", -10), ("b", -1)]
    run = {(r.owner, r.t): r.balance for r in ledger.running_balance(once, "owner", ["t"]).collect()}
    assert run["a", 4] == -10 and run["a", 1] == 10
    assert rows(ledger.consume(once, "owner", ["t"])) == [("a", 5, 2, 1), ("b", 0, 0, 1)]
    paid = spark.createDataFrame([("o1",)], "order_id string")
    assert rows(ledger.new_orders(spark.createDataFrame([("o1",), ("o2",)], "order_id string"), paid)) == [("o2",)]
    assert rows(ledger.grant_once(e.select("owner", "t"), "owner", ["t"])) == [("a", 1, 10), ("b", 1, 10)]


def test_lookups_and_merges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert merge.lookup(df, "k", 1).count() == 1 and merge.lookup(df, "k", 9).count() == 0
    for k, exactly in ((2, False), (9, True)):
        with pytest.raises(ValueError):
            merge.lookup(df, "k", k, exactly)
    z = spark.createDataFrame([(["A", "B"], ["A"])], "r array<string>, g array<string>").select(merge.zipped(F.col("r"), F.col("g"))).first()[0]
    assert [tuple(x) for x in z] == [(0, "A", "A"), (1, "B", "")]


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, parts):
    df = spark.createDataFrame([(i * i % 101, i % 3) for i in range(101)] + [(None, 1)], "x int, v int")
    got = sorted((r.n, r.x, r.s) for r in batching.running(df, "x", ["v"], {"n": F.lit(1), "s": F.col("v")}, parts).collect())
    want = sorted(((x is not None, x, v) for x, v in [(i * i % 101, i % 3) for i in range(101)] + [(None, 1)]), key=lambda t: (t[0], t[1] or 0, t[2]))
    assert [n for n, *_ in got] == list(range(1, 103)) and got[-1][2] == sum(v for *_, v in want)
    assert [x for _, x, _ in got] == [x for _, x, _ in want]


def test_batch_sizes(spark):
    assert batching.checked_size(spark.range(135)).count() == 135
    for n in (0, 136):
        with pytest.raises(ValueError):
            batching.checked_size(spark.range(n))
    assert spark.range(1).select(batching.chunks_needed(F.lit(91))).first()[0] == 3


def test_top_names(spark):
    roll = spark.createDataFrame([(0, "Ana Soto"), (1, "Ana Soto"), (2, "Luis Paz"), (3, "Eva Mar")], "pos int, name string")
    got = {r.text: r.suggestions for r in names.top_names(spark.createDataFrame([("Ana Sotto",), ("Ana Sotto",), ("",)], "text string"), roll).collect()}
    assert got["Ana Sotto"][0] == "Ana Soto" and len(got["Ana Sotto"]) == 2 and got[""] == ["Ana Soto", "Luis Paz"]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    sql = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in sql.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(repr(v) for v in r) for r in sql.fetchall())
    assert Counter(tuple(repr(v) for v in r) for r in df.select(*cols).collect()) == want and want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists("/root/testdata/sf0.001")
