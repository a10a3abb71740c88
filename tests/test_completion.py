import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tiza.sources import lines as growing
from tiza.sources import readers
from tiza.streaming import completion

START = datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def outcomes(spark, out):
    return sorted((r.stream, r.groupId, r.success, r.error, r.closed_by) for r in spark.read.schema(completion.OUTCOME).parquet(out).collect())


def test_open_items_get_an_error(stateful, tmp_path):
    spark, out, folder = stateful, str(tmp_path / "out"), tmp_path / "in"
    schema = "stream string, order long, at timestamp, type string, groupId string, success boolean, data string, error string"
    folder.mkdir()

    def step(number, rows):
        spark.createDataFrame([(s, o, START + timedelta(minutes=m), t, g, ok, None, e) for s, o, m, t, g, ok, e in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        events = spark.readStream.schema(schema).parquet(str(folder)).withWatermark("at", "1 minute")
        q = completion.completed(events, silent=600_000, event_time=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return outcomes(spark, out)

    starts = [(s, -1, 0, "start", g, None, None) for s, g in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("d", "w"))]
    got = step(1, starts + [("a", 2, 1, "done", None, None, None), ("a", 1, 1, "result", "x", True, None), ("b", 1, 1, "failed", None, None, "HTTP 500"), ("d", 3, 1, "result", "w", False, "bad page")])
    first = [("a", "x", True, None, "result"), ("a", "y", False, "No result in the stream", "done"), ("b", "x", False, "HTTP 500", "failed"), ("d", "w", False, "bad page", "result")]
    assert got == first  # c's item is still open
    got = step(2, [("e", 1, 30, "start", "v", None, None)])
    got = step(3, [("e", 2, 31, "result", "v", True, None), ("c", 9, 31, "result", "z", True, None)])
    lost = [("c", "z", False, "The stream was lost", "timeout"), ("c", "z", True, None, "result"), ("e", "v", True, None, "result")]
    assert got == sorted(first + lost)


def test_growing_files_to_outcomes(stateful, tmp_path):
    """Requests and the lines of their streams: the rows of all parts; a stream that ends without a result for an item."""
    spark, out, folder = stateful, str(tmp_path / "out"), tmp_path / "in"
    folder.mkdir()
    requests = tmp_path / "requests"
    spark.createDataFrame([(f"{folder}/{s}", f"{s}{i}") for s in "pq" for i in range(3)], "stream string, item string").coalesce(1).write.parquet(str(requests))
    for s in "pq":
        (folder / s).write_text("".join(json.dumps(x) + "\n" for x in [{"type": "meta", "totalItems": 3}, {"type": "result", "groupId": f"{s}0", "success": True, "data": "1"}, {"type": "result", "groupId": f"{s}2", "success": False, "error": "e"}]) + "garbage\n")
    with open(folder / "p", "a") as f:
        f.write('{"type": "done"}\n')

    def step():
        events = completion.of_lines(readers.parsed_lines(growing.growing_lines(spark, str(folder))))
        items = completion.started(spark.readStream.schema("stream string, item string").parquet(str(requests)), "stream", "item")
        q = completion.completed(items.unionByName(events)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return [(s.rsplit("/", 1)[1], *rest) for s, *rest in outcomes(spark, out)]

    first = [("p", "p0", True, None, "result"), ("p", "p1", False, "No result in the stream", "done"), ("p", "p2", False, "e", "result"), ("q", "q0", True, None, "result"), ("q", "q2", False, "e", "result")]
    assert step() == first
    with open(folder / "q", "a") as f:
        f.write('{"type": "failed", "error": "HTTP 502"}\n')
    assert step() == sorted([*first, ("q", "q1", False, "HTTP 502", "failed")])


def test_batches_settle_as_the_state_does(spark, tmp_path):
    """Random events in batches: the outcomes that a dictionary of open items gives; each batch runs twice."""
    folder, rng, silent = str(tmp_path / "out"), random.Random(3), 1000
    schema = "stream string, order long, type string, groupId string, success boolean, data string, error string"
    want, still, seen = [], {}, {}
    for number, now in enumerate((0, 500, 900, 2500, 2600)):
        rows = []
        for s in rng.sample("abcdefgh", 5 if number else 8):
            for o in sorted(rng.sample(range(50), 9)):
                t = rng.choice(["start", "start", "start", "result", "result", "meta", rng.choice(["done", "failed"])])
                rows.append((s, o, t, rng.choice("xyz") if t in ("start", "result") else None, rng.choice([True, False, None]), None, rng.choice(["e", "", None])))
        rng.shuffle(rows)
        for s in {r[0] for r in rows} | still.keys():
            own, opened = sorted((r for r in rows if r[0] == s), key=lambda r: r[1]), still.setdefault(s, set())
            for _, _, t, g, ok, _, e in own:
                if t == "start":
                    opened.add(g)
                elif t == "result":
                    want.append((s, g, bool(ok), e, "result"))
                    opened.discard(g)
                elif t != "meta":
                    want += [(s, x, False, "No result in the stream" if t == "done" else e or "The stream was lost", t) for x in opened]
                    opened.clear()
            if own:
                seen[s] = now
            elif opened and seen[s] + silent <= now:
                want += [(s, x, False, "The stream was lost", "timeout") for x in opened]
                opened.clear()
        for _ in range(2):
            completion.settle_batch(spark.createDataFrame(rows, schema), number, folder, silent, now=now)
    key = lambda r: tuple(map(str, r))
    got = [(r.stream, r.groupId, r.success, r.error, r.closed_by) for r in completion.outcomes(spark, folder).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[-1] == "timeout" for r in got)
