import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edge import ROWS, edge_docs
from tests.llm.test_byte_bpe import as_library
from tests.llm.test_native import base_spans, counts_of
from tests.llm.test_ngram_join import expected
from tiza.llm import byte_bpe, common, mixing, ngram_join, pii


def masked_plainly(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = []
    for i, r in docs.items():
        n, *_, repeated = counts_of(r.text)
        if n >= 50 and 100 * repeated <= 50 * n:  # no host of these tables is rejected as a whole
            good.append((i, r.text))
    first = {k[0] for k in expected(good) if k[0] == k[1]}
    spans = {r.doc_id: r.spans for r in pii.pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    want = Counter()
    for i, t in good:
        if i in first:
            assert [tuple(s)[:4] for s in spans[i] if s["rank"] < 4] == base_spans(t)
            m = masked_plainly(t, spans[i])
            ids = as_library(m)
            want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(m.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want and 500 < len(want) < len(docs)


def test_stages_keep_columns_and_stand_edge_rows(spark, tmp_path):
    for n, rows in enumerate((ROWS, [])):
        docs = edge_docs(spark, rows) if rows else edge_docs(spark).limit(0)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, None)
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{n}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{i}"))
        assert docs.count() == 0 if not rows else docs.count() <= len(rows)


def test_mixing_order_is_in_the_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.mixed(spark, docs, sf_dir).coalesce(1).write.parquet(str(tmp_path / "m"))
    sources = [r.source for r in spark.read.parquet(str(tmp_path / "m")).collect()]
    share = Counter(sources)
    assert len(share) == 20 and len(sources) == docs.count()
    for at in (400, 600, 800):  # every source has its share of every prefix but for a block and what ended early
        seen = Counter(sources[:at])
        assert all(abs(seen[s] - share[s] * at / len(sources)) <= 2 * 16 for s in share)


def test_run_returns_the_mixing_order(spark, sf_dir, tmp_path):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()]
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(got))
        assert got == [r.doc_id for r in mixing.mix(docs).orderBy("slot", "offset").select("row.doc_id").collect()] and len(got) > 500
        # equal and missing ids: each row has a place of its own
        d = edge_docs(spark, [(i % 50 or None, f"text {i}", "en", "s", 1) for i in range(400)])
        d.repartition(5).write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "d"))
        files = spark.read.parquet(str(tmp_path / "d"))
        rows = corpus_pipeline.tokens(spark, files, None).orderBy("position").collect()
        where = files.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
        want = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in where]
        assert [(r.doc_id, r.decoded_sha256) for r in rows] == want and len({r.position for r in rows}) == 400
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_positions_of_many_files(spark, tmp_path):
    d = edge_docs(spark, [(i, f"text {i}", "en", "s", 1) for i in range(2300)])
    d.coalesce(2).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "d"))
    rows = corpus_pipeline.placed(spark.read.parquet(str(tmp_path / "d")).withColumn("file", F.col("_metadata.file_name"))).collect()
    assert len({r.position for r in rows}) == 2300
    files = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "_metadata.file_name").collect()
    task_file = lambda n: tuple(map(int, (n[5:10], n.rsplit("-c", 1)[1].split(".")[0])))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == [r.doc_id for r in sorted(files, key=lambda r: task_file(r.file_name))]


def test_python_steps_release_memory(spark, monkeypatch):
    """Each function that the n-gram join and the tokens hand to Spark's Python workers releases memory at the end of a task."""
    docs = edge_docs(spark)
    handed, calls, make = [], [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: handed.append(f) or make(self, f, *a, **b))
    ngram_join.keep_first(docs)
    byte_bpe.digests(docs)
    assert len(handed) == 6
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    for n, f in enumerate(handed):
        list(f(iter([])))
        assert len(calls) == n + 1


def test_released_memory_goes_to_the_system():
    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for b in batches:
            held = [pa.array([bytes(1000)] * 100, pa.binary()) for _ in range(2000)]
            assert own() > before + 150
            yield b
            del held

    before = own()
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(3))], ["n"])
    assert list(common.releasing(run)(iter([b]))) == [b] and own() < before + 50
