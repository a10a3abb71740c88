import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import repeated_spans as rs


def expected(rows, length=200):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[i : i + length], digest_size=12).digest()] += 1
    out = Counter()
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        end = 0
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=12).digest()] > 1:
                gone[max(i, end) : i + length] = True
                end = i + length
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        out[doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_expansion_equals_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for length in (1, 2, 5, 9):
        for _ in range(25):
            texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
            texts += [texts[0][3:40]]
            seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            want = [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
            assert [f.tolist() for f in rs.repeats(texts, length)] == want


def test_common_prefixes_come_in_increasing_order():
    """The boundaries left out at a length are those with at least that common prefix."""
    texts = [b"banana band", b"bandana", b"ananas"]
    joined, order, firsts = rs.suffix_order(texts, 64)
    suffixes = [(joined[o:].tobytes().split(b"\0")[0], int(np.searchsorted(firsts, o, "right"))) for o in order]
    assert suffixes == sorted(suffixes)
    is_first = np.zeros(len(joined), bool)
    is_first[firsts] = True
    for length in range(1, 8):
        first, _ = rs.expand(joined[order - 1], ~is_first[order], 3, length)
        for i in range(1, len(order)):
            a, b = suffixes[i - 1][0], suffixes[i][0]
            lcp = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert (first[i] == i) == (lcp < length)


def test_equal_windows_have_equal_names():
    rng = random.Random(9)
    a, b, c = (bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (700, 300, 500))
    names = lambda t: {t[s + k : s + k + 200]: n for n, _, s, w, _ in zip(*rs.pieces(t), strict=True) for k in range(w)}
    x, y = names(a + b), names(c + b + a)
    assert len(x) == 801 and all(y[w] == n for w, n in x.items() if w in y) and len(x.keys() & y.keys()) > 500


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected(rows)
    assert Counter(map(tuple, rs.op5_repeated_spans(spark, sf_dir).collect())) == want and sum(k[2] > 0 for k in want) > 50


def test_weights_count_as_copies():
    rng = random.Random(2)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        weights = [rng.randint(1, 2) for _ in texts]
        plain = rs.repeats([t for t, w in zip(texts, weights, strict=True) for _ in range(w)], 6)
        firsts = np.cumsum([0, *weights[:-1]])
        assert [f.tolist() for f in rs.repeats(texts, 6, weights)] == [plain[i].tolist() for i in firsts]


@pytest.mark.parametrize("text_bytes", [250_000, 1500])
def test_shared_passages_periods_and_edges(spark, tmp_path, text_bytes):
    """With short texts all hot names go through every length of anchors."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij é😀 ") for _ in range(n))
    passage = noise(230)
    rows = [(i, noise(rng.randint(0, 150)) + passage + noise(rng.randint(0, 150)), "en", "s", 1) for i in range(40)]
    rows += [(100, "ab" * 3000, "en", "s", 1), (101, "x" * 199, "en", "s", 1), (102, "x" * 199, "en", "s", 1), (103, "y" * 200, "en", "s", 1), (104, "y" * 200, "en", "s", 1), (105, "z" * 201, "en", "s", 1)]
    rows += ROWS
    edge_docs(spark, rows).write.parquet(str(tmp_path / "d"))
    got = rs.remove_repeats(spark.read.parquet(str(tmp_path / "d")), text_bytes=text_bytes, with_kept=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected([r[:2] for r in rows])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_same_result_when_files_are_split_otherwise(spark, tmp_path):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(300))
    noise = lambda: "".join(rng.choice("abcdefghij ") for _ in range(400))
    rows = [(i, noise() + (passage if i % 3 else noise()), "en", "s", 1) for i in range(300)]
    edge_docs(spark, rows).repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = rs.remove_repeats(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set(name, "20000")
        assert Counter(map(tuple, got.collect())) == expected([r[:2] for r in rows])
    finally:
        spark.conf.set(name, old)


def test_clash_of_hashes_raises():
    import pyarrow as pa

    found = [{"start": 0, "windows": 1, "digest": b"other", "runs": rs.runs_of(np.ones(1, bool)).tobytes()}]
    names = ["doc_id", "n_bytes", "sha", "text", "found"]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([200]), pa.array([None], pa.string()), pa.array(["x" * 200]), pa.array([found])], names)
    with pytest.raises(ValueError, match="share a hash"):
        list(rs._remove(200, False)([batch]))


def test_empty(spark):
    assert rs.remove_repeats(edge_docs(spark).limit(0)).collect() == []
