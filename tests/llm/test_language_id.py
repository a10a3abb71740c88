import random
import zlib

import numpy as np

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import language_id as li


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 512, 1000):
        data = bytes(i % 251 + 1 for i in range(n))
        w = li.windows_of(data)
        assert w.shape == (max(1, -(-n // 256)), 256)
        assert b"".join(x.tobytes() for x in w[: n // 256]) == data[: n // 256 * 256] and (n < 256 or w[-1].tobytes() == data[-256:])


def small():
    r = np.random.default_rng(0)
    net = li.Network(["a", "b", "c"])
    for k in net.p:
        net.p[k] = r.normal(0, 0.4, net.p[k].shape)
    return net, r.integers(0, 256, (3, 256)).astype(np.uint8), np.array([0, 2, 1])


def loss(net, x, y):
    q = net.logits(x, net.tables())
    return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]))


def test_gradients_equal_finite_differences():
    net, x, y = small()
    g = net._step(x, y)
    for k, a in net.p.items():
        where = np.unravel_index(np.argsort(-np.abs(g[k]), axis=None)[:3], a.shape)
        for at in zip(*where, strict=True):
            old, eps = a[at], 1e-5
            a[at] = old + eps
            up = loss(net, x, y)
            a[at] = old - eps
            down = loss(net, x, y)
            a[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-4, k


def test_tables_equal_direct_convolution():
    net, x, _ = small()
    pooled = []
    for w in li.WIDTHS:
        z = np.array([[net.p["E"][row[i : i + w]].ravel() @ net.p[f"W{w}"] for i in range(257 - w)] for row in x])
        pooled.append(np.maximum(z.max(1) + net.p[f"b{w}"], 0))
    assert np.allclose(np.concatenate(pooled, 1) @ net.p["V"] + net.p["c"], net.logits(x, net.tables()))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = li.op3_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    rng = random.Random(5)
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(80))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "x" if i % 2 else "y", "s", 1) for i in range(60)]
    wrong = [(i, t, "x" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted(map(tuple, li.identify(edge_docs(spark, x)).collect())) for x in (rows, wrong))
    assert a == b and all(p == ("x" if i % 2 else "y") for i, _, p, _ in a)


def test_edge_rows(spark):
    got = li.identify(edge_docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id in (1, 2, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert li.identify(edge_docs(spark).limit(0)).collect() == []
    assert {r.lang_pred for r in li.identify(edge_docs(spark, [(i, "some text", None, "s", 1) for i in range(4)])).collect()} == {"und"}
