import random

from tiza.streaming import state

SCHEMA = "k string, part int, at int, v int"


def versions(target):
    return {(int(b.name.removeprefix("bucket=")), int(v.name.removeprefix("v="))) for v in target.glob("v=*") for b in v.glob("bucket=*")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    target = tmp_path / "state"
    rng, want, latest = random.Random(5), {}, {}
    batches = [[(f"k{rng.randrange(40)}", rng.randrange(2), rng.randrange(100), rng.randrange(9)) for _ in range(n)] for n in (120, 1, 0, 3, 2)] + [[(None, 0, 1, 1), (None, 0, 0, 2)]]
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        touched = {r[0] for r in batch.select(state.bucket_of(["k", "part"], 16)).collect()}
        for _ in range(2):  # the batch runs again after a failure
            state.merge_batch(batch, number, str(target), ["k", "part"], ["at"], 16)
        for k, p, at, v in rows:
            want[k, p] = max(want.get((k, p), (-1, 0)), (at, v))
        got = state.latest_state(spark, str(target), SCHEMA).collect()
        assert {(r.k, r.part): (r["at"], r.v) for r in got} == want and len(got) == len(want)
        written = {b for b, v in versions(target) if v == number}
        assert written == touched
        before, latest = latest, latest | {b: number for b in touched}
        assert versions(target) == {*before.items(), *latest.items()}  # the state before and this one, no older version
    assert len(touched) == 1


def test_stream_into_state(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "state")
    for i in range(3):
        spark.createDataFrame([("a", 0, i, i), (f"b{i}", 1, 0, i)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        q = state.keep_latest(spark.readStream.schema(SCHEMA).parquet(str(folder)), target, str(tmp_path / "ck"), ["k"], ["at"], 4)
        q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in state.latest_state(spark, target, SCHEMA).collect()) == [("a", 2), ("b0", 0), ("b1", 1), ("b2", 2)]
    assert state.latest_state(spark, str(tmp_path / "none"), SCHEMA).count() == 0
