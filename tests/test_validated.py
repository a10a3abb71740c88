import json

from pyspark.sql import functions as F

from tiza.functions import checks, json_repair
from tiza.operators import evaluate, scoring, validated
from tiza.sources import lines as growing
from tiza.sources import readers, sinks

REPLIES = [
    '{"puntaje":"3/5","nota":4.5,"retroalimentacion":{"detalle_puntaje_desarrollo":{"P1":{"puntaje":"2/3","cita_estudiante":"c","justificacion":"j"},"P2":"x","P3":{"puntaje":"1/3"}}}}',
    'noise ```json\n{"puntaje":"1/2","retroalimentacion":{}}\n``` end',
    '{"puntaje":"","retroalimentacion":{}}',
    '{"puntaje":"1/2"}',
    "no reply",
    "",
    None,
]


def test_replies_split_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "id int, raw string")
    checked = validated.parsed_replies(df, F.col("raw"))
    counts = validated.split(checked, str(tmp_path / "out"))
    good = {r.id: r.reply for r in spark.read.parquet(f"{tmp_path}/out/outcome=accepted").collect()}
    bad = {r.id: r.reasons for r in spark.read.parquet(f"{tmp_path}/out/outcome=rejected").collect()}
    assert counts == {"rows": 7, "accepted": 2, "rejected": 5} and sorted([*good, *bad]) == list(range(7))
    base = ["no puntaje", "no retroalimentacion"]
    assert bad[2] == base[:1] and bad[3] == base[1:] and all(bad[i] == ["no JSON object", *base] for i in (4, 5, 6))
    assert good[0].nota == 4.5 and good[1].nota == 0 and good[1].retroalimentacion.detalle_puntaje_desarrollo == {}
    assert validated.accepted(checked).count() == 2 and validated.rejected(checked).count() == 5
    points = validated.accepted(checked).select("id", scoring.development_points(json_repair.development_details(F.col("reply"))).alias("n"))
    assert {r.id: r.n for r in points.collect()} == {0: 3, 1: 0}


def test_a_stream_of_lines_splits_without_loss(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / str(i)).write_text('{"type":"result","groupId":"a"}\nbad {\n{"type":"done"}\n[1]\n')
        lines = readers.parsed_lines(growing.growing_lines(spark, str(folder)))
        q = validated.split_stream(validated.with_reasons(lines, {"malformed line": F.col("malformed").isNull()}), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("outcome", "batch").count().collect()
    assert sorted(map(tuple, got)) == [("accepted", 0, 2), ("accepted", 1, 2), ("rejected", 0, 2), ("rejected", 1, 2)]
    assert {r.malformed for r in spark.read.parquet(str(tmp_path / "out")).where("outcome = 'rejected'").collect()} == {"bad {", "[1]"}


def test_required_fields(spark):
    rows = [("0", 1, 1.5, True, ["x"]), ("", 1, 1.5, True, []), ("a", 0, 1.5, True, []), ("a", 1, 0.0, True, []), ("a", 1, float("nan"), True, []), ("a", 1, 1.5, False, []), ("a", 1, 1.5, True, None), (None, 1, 1.5, True, [])]
    df = spark.createDataFrame(rows, "s string, i int, d double, b boolean, a array<string>")
    assert [r[0] for r in df.select(checks.present(*[F.col(c) for c in df.columns])).collect()] == [True] + [False] * 7
    assert spark.range(1).select(checks.present(F.lit(0).cast("decimal(9,2)"))).first()[0] is False


def test_texts_of_values(spark):
    whole = '{"puntaje": "2/3", "cita_estudiante": "dice \\"sí\\"", "justificacion": "bien"}'
    cases = {
        whole: 'Puntaje: 2/3\nRespuesta Estudiante: "dice "sí""\nJustificación: bien',
        '{"cita_estudiante": "c", "justificacion": "j"}': 'Puntaje: undefined\nRespuesta Estudiante: "c"\nJustificación: j',
        '{"puntaje": 1, "cita_estudiante": "", "justificacion": "j"}': '{"puntaje":1,"cita_estudiante":"","justificacion":"j"}',
        '{"b": [1, {"a": null}], "a": 2}': '{"b":[1,{"a":null}],"a":2}',
        "[1, 2]": "[1,2]",
        "3": "3",
        "true": "true",
        '"text"': "text",
        "null": "",
        "plain text": "plain text",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(json_repair.value_text(F.col("v"))).collect()] == list(cases.values())
    assert spark.range(1).select(json_repair.value_text(F.lit(None).cast("string"))).first()[0] == ""
    details = spark.createDataFrame([(1, {"P_1": whole})], "student int, detail map<string,string>")
    none = spark.createDataFrame([], "student int, pos int, section string, detail string")
    assert evaluate.report_rows(none, details).first().detail.startswith("Puntaje: 2/3\n")


def test_paths_in_json(spark):
    cases = ['[{"remaining": 5}]', '[{"remaining": "7"}]', '[{"remaining": null}]', "[]", '[{"x": 1}]', "{}", "bad", '[{"remaining": "many"}]', None]
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    assert [r[0] for r in df.select(json_repair.path_number(F.col("raw"), "$[0].remaining")).collect()] == [5, 7] + [None] * 7
    assert [r[0] for r in df.select(json_repair.path_exists(F.col("raw"), "$[0].remaining")).collect()] == [True, True, False, False, False, False, False, True, False]


def test_protocol_stands_once(spark, tmp_path):
    rows = [(i, f"g{i}", i % 7 > 0, f"d{i}" if i % 7 else None, None if i % 7 else "e") for i in range(100)]
    df = spark.createDataFrame(rows, "n int, groupId string, success boolean, data string, error string")
    for _ in range(2):
        sinks.write_protocol(df, str(tmp_path / "p"), "n", 3)
    files = sorted((tmp_path / "p").glob("part-*.txt"))
    got = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(files) == 3 and got[0] == {"type": "meta", "totalItems": 100, "totalBatches": 3, "batchSize": 45, "maxConcurrent": 3} and got[-1] == {"type": "done"}
    assert [(x["groupId"], x["batchIndex"]) for x in got[1:-1]] == [(f"g{i}", i // 45) for i in range(100)]
    assert got[1] == {"type": "result", "batchIndex": 0, "groupId": "g0", "success": False, "error": "e"}

    folder = tmp_path / "in"
    for i in range(2):
        df.limit(50).coalesce(1).write.mode("append").parquet(str(folder))
        q = sinks.stream_protocol(spark.readStream.schema(df.schema).parquet(str(folder)), str(tmp_path / "s"), str(tmp_path / "ck"), "n")
        q.awaitTermination(120)
    events = readers.event_lines(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, events.groupBy("batch", "type").count().collect())) == [(b, t, n) for b in (0, 1) for t, n in (("done", 1), ("meta", 1), ("result", 50))]


def test_the_cut_text_is_worked_out_once(spark):
    df = spark.createDataFrame([('x {"a":1} y',), ("no\nJSON",), ("```json\n{}\n```",)], "t string").select(json_repair.cut_json(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ['{"a":1}', "no JSON", "{}"]
    assert df._jdf.queryExecution().analyzed().toString().count(r"\{.*\}") == 1
