import json

import pytest
from pyspark.sql import functions as F

from tiza.sources import readers, sinks
from tiza.streaming import progress


def test_forms_and_bodies(spark):
    df = spark.createDataFrame([("application/x-www-form-urlencoded; charset=utf-8", "a=1&b=x+y%20z&a=2&&c"), ("application/json", '{"a":"1"}'), ("text/plain", "zzz")], "t string, b string")
    got = [r[0] for r in df.select(readers.body(F.col("t"), F.col("b"))).collect()]
    assert got[0] == {"a": "1", "b": "x y z", "c": ""} and got[1] == {"a": "1"} and not got[2]


def test_data_urls_and_types(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",)], "u string").select(readers.data_url(F.col("u")).alias("x"))
    assert [(r.x.mime, bytes(r.x.content)) for r in df.collect()] == [("image/png", b"hi"), ("application/octet-stream", b"hi")]
    z = spark.createDataFrame([(["a", "", None, "d"], ["1", "2", "3", "4"])], "u array<string>, m array<string>").select(readers.with_types(F.col("u"), F.col("m"))).first()[0]
    assert [tuple(x) for x in z] == [("a", "1"), ("d", "4")]
    assert readers.accepted(spark.createDataFrame([("image/png",), ("video/mp4",)], "mime string")).count() == 1
    assert readers.plans(spark).count() == 4 and [r.id for r in readers.plans_by_price(readers.plans(spark, [*readers.PLANS, ("none", "x", None, 1, 1)])).collect()][:2] == ["free", "none"]
    f = readers.upload(spark.createDataFrame([("a.png", '["x","y"]'), ("b.png", "zzz")], "file string, n string"), F.col("n")).collect()
    assert [r.names for r in f] == [["x", "y"], []]
    pages = spark.createDataFrame([([["a", "b"], ["c"]],)], "p array<array<string>>").select(readers.layer_text(F.col("p")))
    assert pages.first()[0] == "a b\nc"


LINES = [
    {"type": "meta", "totalItems": 3, "totalBatches": 1},
    {"type": "result", "groupId": "a", "success": True, "data": "1"},
    {"type": "result", "groupId": "b", "success": False, "error": "x"},
    "not json {",
    {"type": "result", "groupId": "a", "success": True, "data": "2"},
    {"type": "done"},
]


@pytest.fixture
def lines(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i, x in enumerate(LINES):
        (d / f"{i}.json").write_text((x if isinstance(x, str) else json.dumps(x)) + "\n")
    return d


def test_stream_equals_batch(spark, lines, tmp_path):
    batch = progress.counters(readers.event_lines(spark, str(lines)))
    q = progress.counters(progress.event_stream(spark, str(lines), 1)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect())) == [(False, 1), (True, 2)]


def test_closing(spark, lines):
    open_groups = spark.createDataFrame([("a",), ("c",)], "group_id string")
    assert [tuple(r) for r in progress.closed(open_groups, readers.event_lines(spark, str(lines)), "lost").collect()] == [("c", "lost")]


def test_once_within_watermark(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "e")).withColumn("k", F.get_json_object("props", "$.k"))
    once = progress.once_within(s, ["user_id", "k"], "ts", "40 days")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(180)
    plain = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.get_json_object("props", "$.k").alias("k")).distinct().count()
    assert spark.table("once").count() == plain


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([("Ana", "3/5", "x\ny")], "name string, score string, note string")
    sinks.write_csv(g, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "c")).first().note == "x\ny"
    sinks.write_table_document(g, str(tmp_path / "t"), ["name", "note"])
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "<tr><td>Ana</td><td>x<br>y</td></tr>"
    sinks.write_event_lines(spark.createDataFrame([("done",)], "type string"), str(tmp_path / "l"))
    assert readers.event_lines(spark, str(tmp_path / "l")).first().type == "done"
    a, b = sinks.first_and_rest(F.array(*[F.lit(i) for i in range(7)]))
    assert tuple(spark.range(1).select(a, b).first()) == ([0, 1, 2, 3, 4], [5, 6])
