from datetime import datetime, timedelta

from tiza.streaming import codes, completion

START = datetime(2024, 1, 1)
SCHEMA = "owner string, type string, code string, at timestamp, expires timestamp"


def test_codes_serve_once_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.PROVIDER)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    at = lambda m: None if m is None else START + timedelta(minutes=m)

    def step(rows):
        spark.createDataFrame([(o, t, c, at(m), at(e)) for o, t, c, m, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        events = spark.readStream.schema(SCHEMA).parquet(str(folder)).withWatermark("at", "0 minutes")
        q = codes.checked_codes(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        state = spark.read.format("statestore").option("stateVarName", "valid").load(str(tmp_path / "ck"))
        left = {(r.key.owner, r.user_map_key.code) for r in state.collect()} if "user_map_key" in state.columns else set()
        return sorted((r.owner, r.code, r.outcome) for r in spark.read.schema(codes.OUTCOME).parquet(out).collect()), left

    try:
        first = [("a", "1", "accepted"), ("a", "1", "rejected"), ("a", "9", "rejected"), ("b", "1", "rejected")]
        got, left = step([("a", "use", "1", 1, None), ("a", "issue", "1", 0, 10), ("a", "use", "1", 2, None), ("a", "use", "9", 2, None), ("a", "issue", "2", 2, 12), ("b", "issue", "3", 2, 12), ("b", "use", "1", 3, None)])
        assert got == first and left == {("a", "2"), ("b", "3")}
        second = [*first, ("b", "3", "rejected"), ("c", "5", "accepted"), ("a", "2", "expired"), ("b", "3", "expired")]
        got, left = step([("b", "use", "3", 12, None), ("c", "issue", "5", 12, 30), ("c", "use", "5", 29, None), ("c", "issue", "6", 29, 60)])
        assert got == sorted(second) and left == {("c", "6")}  # used and expired codes have left the state
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
