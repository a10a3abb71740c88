import json

import pytest
from pyspark.sql import functions as F

from tiza.sources import lines as growing
from tiza.sources import readers


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_lines_split_over_appends_come_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    result = lambda g: json.dumps({"type": "result", "groupId": g, "success": True}).encode()
    out = str(tmp_path / "out")

    def step():
        events = readers.parsed_lines(growing.growing_lines(spark, f"file://{folder}"))
        q = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.groupId or "", r.malformed or "") for r in spark.read.parquet(out).collect())

    first, second = result("ñandú"), result("b")
    append(folder / "a.ndjson", first[:20])
    append(folder / "b.ndjson", second + b"\n\n   \nnot json {\n" + result("c")[:5])
    append(folder / "_hidden", b"x\n")
    assert step() == [("", "not json {"), ("b", "")]
    append(folder / "a.ndjson", first[20:])  # still without its end
    assert step() == [("", "not json {"), ("b", "")]
    append(folder / "a.ndjson", b"\r\n" + result("d") + b"\n")
    append(folder / "b.ndjson", result("c")[5:] + b"\n5\nnull\n")
    assert step() == [("", "5"), ("", "not json {"), ("", "null"), ("b", ""), ("c", ""), ("d", ""), ("ñandú", "")]
    assert step() == step()


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_every_chunk_size_gives_the_same_lines(monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(growing, "CHUNK", chunk)
    monkeypatch.setattr(growing, "BLOCK", 3)
    text = "é\n\nab\n" + "long " * 30 + "\nx\n  \n" + "y" * 15 + "\nrest"
    (tmp_path / "f").write_text(text)
    end = growing.complete(str(tmp_path), {})
    got = [(p, v) for part in growing.parts({}, end) for b in growing.read_part(str(tmp_path), part) for p, v in zip(b.column("position").to_pylist(), b.column("value").to_pylist())]
    data = text.encode()
    assert [v for _, v in got] == [x for x in text.split("\n")[:-1] if x.strip()]
    assert all(data[p:].startswith(v.encode()) for p, v in got) and len({p for p, _ in got}) == len(got)
    assert end[str(tmp_path / "f")] == data.rfind(b"\n") + 1
    assert growing.complete(str(tmp_path / "none"), {"gone": 5}) == {"gone": 5}


def test_batch_and_stream_agree(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}").write_text("".join(json.dumps({"type": "result", "groupId": f"{i}-{j}"}) + "\n" for j in range(50)) + '{"type": "res')
    batch = growing.growing_lines(spark, str(folder), stream=False)
    assert batch.count() == 150 and batch.agg(F.countDistinct("value")).first()[0] == 150
    got = run(growing.growing_lines(spark, str(folder)), "grown", tmp_path / "ck")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert growing.growing_lines(spark, str(empty), stream=False).count() == 0
