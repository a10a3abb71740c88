import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiza.functions import checks, dates, json_repair, numeric, similarity, text


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


GRADES = [(0, 60, 60, 1.0), (-5, 60, 60, 1.0), (18, 60, 60, 2.5), (36, 60, 60, 4.0), (48, 60, 60, 5.5), (60, 60, 60, 7.0), (70, 60, 60, 7.0), (10, 0, 60, 1.0), (10, 60, 0, 1.0), (60, 60, 100, 4.0), (61, 60, 100, 7.0), (2, 2, 60, 4.0)]


def test_grades(spark):
    got = values(spark, numeric.grade(F.col("s"), F.col("m"), F.col("p")), [tuple(map(float, g[:3])) for g in GRADES], "s double, m double, p double")
    assert got == [g[3] for g in GRADES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 120), st.integers(1, 100), st.integers(1, 120)), min_size=50, max_size=80))
def test_grades_are_bounded_and_monotone(spark, rows):
    rows = [tuple(map(float, r)) for r in rows]
    df = spark.createDataFrame(rows, "s double, m double, p double")
    g = lambda d: numeric.grade(F.col("s") + d, F.col("m"), F.col("p"))
    for r in df.select("s", "m", "p", g(0).alias("a"), g(1).alias("b"), numeric.pass_points(F.col("m"), F.col("p")).alias("ap")).collect():
        assert 1.0 <= r.a <= r.b <= 7.0
        assert r.s < r.ap or r.a >= 4.0


def test_lenient_numbers(spark):
    rows = [("12abc",), (" -7 ",), ("abc",), ("",), ("3.5x",)]
    assert values(spark, numeric.parse_int(F.col("x")), rows, "x string") == [12, -7, None, None, 3]
    assert values(spark, numeric.parse_number(F.col("x")), rows, "x string") == [0.0, -7.0, 0.0, 0.0, 0.0]
    assert values(spark, numeric.parse_leading_number(F.col("x")), rows, "x string") == [12.0, -7.0, 0.0, 0.0, 3.5]
    assert values(spark, numeric.clamp_grade(F.col("x")), [("9",), ("x",), ("0",), ("5.5",), ("NaN",)], "x string") == [7.0, 1.0, 1.0, 5.5, 1.0]
    assert values(spark, numeric.progress(F.col("a"), F.col("b")), [(1, 8), (0, 0)], "a int, b int") == [13, 0]
    assert values(spark, numeric.amount(F.col("a")), [(1000.5,), (12.5,)], "a double") == [1000.5, 13.0]
    assert all(len(x) == 6 for x in values(spark, numeric.random_code(), [(1,)] * 20, "a int"))


ANSWERS = [
    ("b", "SM1", None, "B", "high"), ("B) foo", "SM1", None, "B", "high"), ("BANANA", "SM1", None, "B", "low"), ("v", "VF1", None, "V", "high"), ("FALSO", "VF1", None, "F", "low"),
    ("termino 3", "TP1", None, "3", "high"), ("termino 3", "X", "terminos_pareados", "3", "high"), ("12 x", "X", None, "12", "low"), ("F", "X", None, "F", "low"), ("zzz", "X", None, "SIN_RESPUESTA", "low"),
    ("", "SM1", None, "SIN_RESPUESTA", "low"), ("EMPTY", "X", "sm_vf", "E", "low"), ("A", "7", None, "A", "high"), (None, "SM1", None, "SIN_RESPUESTA", "low"),
]


def test_answers(spark):
    got = values(spark, text.normalise_answer(F.col("t"), F.col("q"), F.col("m")), [a[:3] for a in ANSWERS], "t string, q string, m string")
    assert [tuple(g) for g in got] == [a[3:] for a in ANSWERS]


def test_review(spark):
    rows = [("SM1", "A", "A"), ("SM1", "B", "A"), ("VF1", "X", ""), ("TP1", "4", "4"), ("SM1", "", ""), ("TP1", "ABC", "")]
    assert values(spark, text.needs_review(F.col("q"), F.col("g"), F.col("r")), rows, "q string, g string, r string") == [False, True, True, False, True, True]


def test_texts(spark):
    one = lambda e, *v: values(spark, e(F.col("x")), [(a,) for a in v], "x string")
    assert one(text.strip_html, "<p>a <b>b</b></p>\n c") == ["a b c"]
    assert one(text.clean_control, "a\x01b  c", "", None, " \n ") == ["ab c", "—", "—", "—"]
    assert one(text.strip_marks, "a[OMR_MARK] x\ny\nb") == ["ay\nb"]
    assert one(text.slug, "Ana M. 1") == ["Ana_M__1"] and one(text.label, "a_b_c") == ["a b c"] and one(text.line_breaks, "a\nb") == ["a<br>b"]
    assert one(lambda c: text.plan_of_subject(c, "shop-plan-"), "shop-plan-Pro", "other", None) == ["pro", None, None]
    assert one(text.without_slashes, "http://a//") == ["http://a"] and one(text.masked_secret, "0123456789abcdef") == ["012345…cdef"]
    default = "https://api.mistral.ai/v1"
    assert one(text.repaired_url, "[x](https://h/v1)", "'h.org/'", " http://h.net ", "not a url", "", None) == ["https://h/v1", "https://h.org/v1", "http://h.net/v1", default, default, default]
    assert one(lambda c: text.shortened(c, 3), "abcd", "é", None) == ["abc", "é", None]
    assert one(lambda c: text.valid_email(c), "a@b.c", "x a@b.c", "a@b") == [True, False, False]
    assert one(lambda c: text.valid_email(c, "loose"), "x a@b.c") == [True] and one(lambda c: text.valid_email(c, "basic"), "a@b", "a@bc") == [False, True]
    assert [tuple(x) for x in one(text.score_parts, "3/5")] == [("3", "5")]


def test_names_and_feedback(spark):
    rows = [("La alumna Ana Soto escribe", None), ("Pedro Rojas muestra orden", ""), ("Nada", "Luz"), ("Nada", "Estudiante")]
    assert values(spark, text.student_name(F.col("t"), F.col("k")), rows, "t string, k string") == ["Ana Soto escribe", "Pedro Rojas", "Luz", "El estudiante"]
    rows = [("Buen trabajo", "Luz"), ("El estudiante avanza", "Luz")]
    assert values(spark, text.prefixed_feedback(F.col("t"), F.col("k")), rows, "t string, k string") == ["Luz buen trabajo", "El estudiante avanza"]


def test_a_name_ends_before_the_first_verb(spark):
    rows = [("Ana Soto muestra Tiened the", "Estudiante"), ("Ana Soto muestra haen tienea", "Estudiante"), ("Ana María Soto Vera tiene ideas", "")]
    assert values(spark, text.student_name(F.col("t"), F.col("k")), rows, "t string, k string") == ["Ana Soto", "Ana Soto", "Ana María Soto Vera"]


def test_signing(spark):
    import hashlib
    import hmac
    from urllib.parse import quote

    params = {"b": "x y+z", "A": "1", "a": "", "ñ": "ñ", "n": "!~*'()", "o": "€", "É": "%", "e": "a&b=c", "B": "/?", "z": "-_."}
    df = spark.createDataFrame([(params,)], "p map<string,string>").select(text.query_string(F.col("p")).alias("q"))
    q = df.first().q
    assert q == "&".join(f"{quote(k, safe='')}={quote(params[k], safe="!~*'()")}" for k in ["a", "A", "b", "B", "e", "É", "n", "ñ", "o", "z"])
    for secret in ("key", "k" * 64, "clé" * 40, ""):
        for t in ("", q, "x" * 1000):
            got = spark.range(1).select(text.signed(F.lit(t), secret)).first()[0]
            assert got == hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest()
    assert spark.range(1).select(text.signed(F.lit(None).cast("string"), "k")).first()[0] is None


def dice_plain(a, b):
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    rest, hit = [b[i : i + 2] for i in range(len(b) - 1)], 0
    for i in range(len(a) - 1):
        if a[i : i + 2] in rest:
            rest.remove(a[i : i + 2])
            hit += 1
    return 2 * hit / (len(a) + len(b) - 2)


def test_dice(spark):
    rows = [("night", "nacht"), ("aaaa", "aa"), ("", ""), ("a", "b"), ("a b", "ab"), ("abcabc", "bcabca"), ("x", "xyz")]
    got = values(spark, similarity.dice(F.col("a"), F.col("b")), rows, "a string, b string")
    assert all(math.isclose(g, dice_plain(*r)) for g, r in zip(got, rows, strict=True))


def test_json(spark):
    raw = ['```json\n{"puntaje":"3/5","retroalimentacion":{}}\n```', 'noise {"puntaje":"1/2","nota":4.5,"retroalimentacion":{"correccion_detallada":[{"seccion":"a","detalle":"b"}]}} end', '{"nota":3}', "not json"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").withColumn("v", json_repair.parsed(F.col("raw")))
    got = df.select(json_repair.usable(F.col("v")).alias("ok"), json_repair.with_defaults(F.col("v")).alias("d")).collect()
    assert [r.ok for r in got] == [True, True, False, False]
    assert got[0].d.nota == 0.0 and got[0].d.retroalimentacion.correccion_detallada == [] and got[0].d.retroalimentacion.resumen_general.fortalezas == ""
    assert got[1].d.nota == 4.5 and got[1].d.retroalimentacion.correccion_detallada[0].detalle == "b"
    assert values(spark, json_repair.string_list(F.col("x")), [('["a","b"]',), ("zzz",), (None,)], "x string") == [["a", "b"], [], []]
    assert values(spark, json_repair.first_of(F.col("a"), F.col("b")), [("", "x"), ("y", "x")], "a string, b string") == ["x", "y"]


def test_json_cut(spark):
    raw = ["```json\n {\"a\":1} \n``` x", "x {\"a\":1} y", " plain ", "x {\"a\":\n1 y} z", None]
    assert values(spark, json_repair.cut_json(F.col("x")), [(r,) for r in raw], "x string") == ['{"a":1}', '{"a":1}', "plain", '{\\"a\\": 1 y}', None]
    m = spark.createDataFrame([({"b": "2", "a": "1"},), (None,)], "m map<string,string>")
    assert [r[0] and [tuple(e) for e in r[0]] for r in m.select(json_repair.entries(F.col("m"))).collect()] == [[("a", "1"), ("b", "2")], None]


def test_checks(spark):
    rows = [("10.5",), ("0",), ("-1",), ("x",), (None,), ("5000.4",), ("5000.5",), ("Infinity",)]
    assert values(spark, checks.positive_amount(F.col("x")), rows, "x string") == [True, False, False, False, False, True, True, False]
    assert values(spark, checks.payable(F.col("x")), rows[:7], "x string") == [True, True, False, False, False, True, False]
    assert values(spark, checks.payable(F.col("x"), 0), [("9999",)], "x string") == [True]
    assert values(spark, checks.price_fits(F.col("p"), F.col("q")), [("5", 5), ("5", 6), ("0", 0), ("5", None)], "p string, q int") == [True, False, False, False]
    assert values(spark, checks.paid(F.col("x")), [("PAID",), ("open",), (None,)], "x string") == [True, False, False]
    assert values(spark, checks.exactly_paid(F.col("x")), [("PAID",), ("paid",), (None,)], "x string") == [False, True, False]
    assert values(spark, checks.present(F.col("a"), F.col("b")), [("x", 1), ("", 1), ("x", 0), (None, 1)], "a string, b int") == [True, False, False, False]
    assert values(spark, checks.pending(F.col("f"), F.col("a"), F.col("b")), [(["x"], False, None), ([], False, False), (None, None, None), (["x"], True, False)], "f array<string>, a boolean, b boolean") == [True, False, False, False]


def test_dates(spark):
    ts = F.lit("2024-02-28 23:55:01.5").cast("timestamp")
    one = spark.range(1).select(dates.iso_utc(ts), dates.iso_utc(dates.code_expiry(ts)), dates.day_month_year(dates.days_later(ts, 2)), dates.days_later(ts, F.lit(None).cast("int"))).first()
    assert tuple(one) == ("2024-02-28T23:55:01.500Z", "2024-02-29T00:05:01.500Z", "01/03/2024", None)


@pytest.mark.parametrize("rule", ["strict", "loose", "basic"])
def test_null_email(spark, rule):
    assert values(spark, text.valid_email(F.col("x"), rule), [(None,)], "x string") == [None]
