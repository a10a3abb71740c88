import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import ngram_join as nj


def plain_set(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows, threshold=0.8):
    """Brute force over shared shingles."""
    sets = [plain_set(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    both = Counter()
    for at in where.values():
        for x, i in enumerate(at):
            for j in at[x + 1 :]:
                both[i, j] += 1
    group, near = list(range(len(rows))), defaultdict(set)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, j), n in both.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            near[i].add(j), near[j].add(i)
            group[root(i)] = root(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[root(i)].append(rows[i][0])
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        smallest = min((x for x in ids[root(i)] if x is not None), default=None)
        out[doc_id, smallest, len(near[i]), sum(sets[j] == sets[i] for j in near[i]), len({sets[j] for j in near[i]} - {sets[i]})] += 1
    return out


def test_shingles_equal_plain_sets():
    for t in ("", "a", "A b-c d,e f  g", "É x é 1 2 3 4 5 6", "a b c d e a b c d e a b c d e f", "x\ny\tz " * 40):
        assert len(nj.shingles(t)) == len(plain_set(t))
    assert (nj.shingles("A b, c d. e f") == nj.shingles("a B c\nd E f")).all()


def test_target_recall():
    runs = nj.runs_for(0.8)
    assert nj.miss_rate(0.8, runs) < 1e-4 and nj.miss_rate(0.72, runs) < 1e-2
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 360).astype(np.uint64)
        a, b = np.sort(s[:324]), np.sort(s[36:])  # 288 of 360: 0.8
        lost += not set(nj.leaves(nj.signature(a), runs)) & set(nj.leaves(nj.signature(b), runs))
    assert lost <= 1


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected(rows)
    assert Counter(map(tuple, nj.op2_ngram_join(spark, sf_dir).collect())) == want and sum(k[4] > 0 for k in want) > 10


@pytest.fixture(scope="module")
def family():
    """Two large families of near copies with copies of copies, some strangers, and edge rows."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for base in range(2):
        w = [word() for _ in range(120)]
        for i in range(90):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word()
            rows += [(1000 * base + i, " ".join(v), "en", "s", 1)] * (3 if i % 30 == 0 else 1)
    rows += [(5000 + i, " ".join(word() for _ in range(rng.randint(1, 60))), "en", "s", 1) for i in range(60)]
    return rows + ROWS


def test_large_groups_in_chunks_and_splits(spark, family, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 16)
    d = edge_docs(spark, family)
    got = nj.jaccard_join(d, split=40)
    assert Counter(map(tuple, got.collect())) == expected([r[:2] for r in family])


def test_long_sets_make_small_chunks(spark, family, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 16)
    monkeypatch.setattr(nj, "LONG", 20)
    rows = [r for r in family if r[0] is not None and r[0] < 1000][:60]
    assert Counter(map(tuple, nj.jaccard_join(edge_docs(spark, rows)).collect())) == expected([r[:2] for r in rows])


def test_a_hub_and_a_heavy_path_are_no_hot_keys(spark):
    """A vertex with most edges, and a path that most rows share: their joins are by broadcast, and the rows are dealt out by a hash."""
    star = spark.range(1, 3000).selectExpr("id AS u", "0L AS v").union(spark.range(5000, 5100).selectExpr("id AS u", "id + 1 AS v"))
    got = {r.v: r.label for r in nj.components(star).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5101)}
    rows = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE -1 END AS path", "CAST(CAST(id AS STRING) AS BINARY) AS key", "1L AS size")
    found = nj._of(rows, nj._sizes(rows).where("n > 1").select("path", "n", "weight"))
    assert found.count() == found.where("path = -1").count() == rows.where("path = -1").count()
    dealt = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.9 * 66_667


def test_keep_first(spark, family, tmp_path):
    edge_docs(spark, family).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    got = nj.keep_first(d)
    assert got.columns == d.columns
    classes = {k[:2] for k in expected([r[:2] for r in family])}
    kept = Counter(r.doc_id for r in got.collect())
    assert set(kept) == {c for i, c in classes if i == c} and max(kept.values()) == 1
    # texts without words stay; the null id's text is that of doc 5
    assert {1, 2, 4} <= set(kept) and None not in kept


def test_other_thresholds(spark, family):
    """Links at 0.5 are found with the runs and the branching that the threshold asks for."""
    assert nj.runs_for(0.5) > nj.runs_for(0.8) > nj.runs_for(0.95)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(60):  # chains of texts that keep about three quarters of their words' neighbourhoods
        w = [word() for _ in range(200)]
        for i in range(4):
            rows.append((10 * k + i, " ".join(w), "en", "s", 1))
            at = rng.randrange(120)
            w[at : at + 45] = [word() for _ in range(45)]
    for t in (0.5, 0.9):
        want = expected([r[:2] for r in rows], t)
        links = lambda c: sum(k[2] * n for k, n in c.items())
        got = Counter(map(tuple, nj.jaccard_join(edge_docs(spark, rows), threshold=t).collect()))
        assert 0.9 * links(want) <= links(got) <= links(want) and (t > 0.5 or links(want) > 100)
    with pytest.raises(ValueError):
        nj.runs_for(0)


def test_null_ids(spark):
    """Many rows without an id, each with its own text and a near copy, meet nowhere by their missing ids."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(200):
        w = [word() for _ in range(100)]
        rows += [(None, " ".join(w), "en", "s", 1), (None, " ".join([*w[:-1], word()]), "en", "s", 1)]
    assert Counter(map(tuple, nj.jaccard_join(edge_docs(spark, rows)).collect())) == Counter({(None, None, 1, 0, 1): 400})
    assert nj.keep_first(edge_docs(spark, rows)).count() == 200


def test_same_rows_stay_when_files_are_split_otherwise(spark, family, tmp_path):
    """Split sizes change with settings and live cores; between the call and its action they must not change the result."""
    edge_docs(spark, family).repartition(5).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    want = sorted(map(str, nj.keep_first(d).collect()))
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", "100000000"):
            spark.conf.set(name, old)
            got = nj.keep_first(d)
            spark.conf.set(name, size)
            assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.set(name, old)
    # rows that an explode makes share their place in the file, and are written first
    twice = d.withColumn("doc_id", F.explode(F.array("doc_id", F.col("doc_id") + 100_000)))
    ids = {r.doc_id for r in nj.keep_first(d).collect()}
    assert {r.doc_id for r in nj.keep_first(twice).collect()} - {100_000 + i for i in (1, 2, 4)} - {None} == ids - {None}


def test_empty(spark):
    d = edge_docs(spark).limit(0)
    assert nj.jaccard_join(d).collect() == [] and nj.keep_first(d).collect() == []


def test_bucket_of_a_million_keys(spark):
    n = 1_000_000
    keys = spark.range(n).selectExpr("id % 2 AS half", "sha(CAST(id AS STRING)) AS key")
    both = keys.selectExpr("1L AS path", "key").union(keys.selectExpr("2L AS path", "key")).union(keys.selectExpr("10 + half AS path", "key"))
    got = {r.path: r for r in nj._sizes(both.selectExpr("path", "key", "2500L AS size")).collect()}
    assert got[1].weight == 3 * n and (got[1].n, got[10].n, got[11].n) == (n, n // 2, n // 2)
    assert got[1][1:] == got[2][1:] and len({(r.x, r.y) for r in got.values()}) == 3


def test_recall_of_split_buckets():
    """Pairs whose buckets are split to the deepest level reach the target as well."""
    for t in (0.5, 0.8, 0.9):
        rate = lambda **tree: nj.shared_miss_rate(t, nj.runs_for(t), threshold=t, **tree)  # noqa: E731, B023
        assert rate() < 1e-4 and rate(more_levels=nj.MORE_LEVELS) < 1e-4
    assert nj.shared_miss_rate(0.8, nj.runs_for(0.8), more_levels=nj.MORE_LEVELS, ways=1) > 1e-3
    runs = 3  # so few that losses show
    names = pa.schema([("path", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("sig", pa.binary())])

    def deepest(sig):
        paths = [nj._signed(p) for p in nj.leaves(sig, runs)]
        rows = pa.RecordBatch.from_arrays([pa.array(paths), *[pa.array([x] * len(paths), t) for x, t in ((b"", pa.binary()), (9, pa.int64()), (sig.tobytes(), pa.binary()))]], schema=names)
        for level in range(nj.MORE_LEVELS):
            (rows,) = nj._deeper(1 if level else nj.AGAIN)([rows])
        return set(rows.column(0).to_pylist())

    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(400):
        s = rng.integers(0, 1 << 63, 360).astype(np.uint64)
        a, b = np.sort(s[:324]), np.sort(s[36:])  # 288 of 360: 0.8
        lost += not deepest(nj.signature(a)) & deepest(nj.signature(b))
    assert lost / 400 < 0.1 < nj.shared_miss_rate(0.8, runs=runs, more_levels=nj.MORE_LEVELS, ways=1)


def test_texts_come_in_short_batches(spark):
    """The Arrow batches of a step that _in_batches() runs, and the setting after it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    got = nj._in_batches(spark, nj.BATCH, lambda: nj.checkpointed(spark.range(3000, numPartitions=1).mapInArrow(lengths, "n bigint")))
    n = [r.n for r in got.collect()]
    assert sum(n) == 3000 and max(n) <= nj.BATCH and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
