import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import edge_docs
from tiza.llm import spelling_variants as sv
from tiza.llm.common import LOWER, UPPER


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, factor=sv.FACTOR):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= factor * n else None
        out[w] = (n, form, len(near), counts[form] if form else None)
    root = lambda w: root(out[w][1]) if out[w][1] else w
    return {(w, n, form, root(w), near, m) for w, (n, form, near, m) in out.items()}


def rows(df):
    return {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("part", [2, 4000])
def test_equals_brute_force(spark, part):
    rng = random.Random(7)
    words = {}
    for _ in range(40):  # families of edits over few letters, accents among them; chains of rising counts
        w, n = "".join(rng.choice("abcdeéïx") for _ in range(rng.randint(6, 9))), rng.choice([5, 30, 200])
        for _ in range(8):
            words[w] = n
            i, c = rng.randrange(len(w)), rng.choice("abcdeéïÿ")
            w, n = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]), max(1, n + rng.choice([-4, 0, 200]))
    words |= {"x" * 300: 9, "x" * 301: 50, "abcabc": 7, "bacabc": 7}
    got = rows(sv.grouped_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), part=part))
    assert got == brute_force(words) and any(form for _, _, form, root, _, _ in got if root not in (form, None))


def test_bands_cut_all_bits(spark):
    w = spark.createDataFrame([("abcdef",), ("aabbccÿ",), ("",)], "word string").select(sv.parity_mask(F.col("word")).alias("mask"))
    assert [r.mask for r in w.collect()][::2] == [0b111111, 0]
    a, b, c = sv.bands(w)
    assert a | b | c == 2**sv.BITS - 1 and a & b == a & c == b & c == 0


def test_whole_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert rows(sv.op11_spelling_variants(spark, sf_dir)) == {tuple(r) for r in con.sql(f"SELECT word, n, form, root, n_near, form_n FROM ({sv.ORACLE})").fetchall()}


def test_runs_lose_letters(spark):
    docs = [(i, "Straße ÀÉÎÕÜŒa × aaaaaaa BBBBBBB") for i in range(3000)] + [(None, "zzzzzzzz")] * 5
    want = Counter()
    for i, t in docs:
        for run in ("straße", "aaaaaaa", "bbbbbbb") if i is not None else ("zzzzzzzz",):
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    got = {r.word: r.n for r in sv.counted_words(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5 and len(w) >= 6} and {"aaaaaa", "straße"} <= set(got)


def test_edge_rows(spark):
    d = edge_docs(spark)
    texts = [(r.doc_id, r.text) for r in d.collect()]
    got = {r.word: r.n for r in sv.counted_words(d, least_count=2).collect()}
    assert got == {"dolor": 0, "größer": 0} or set(got) <= {w for _, t in texts if t for w in t.translate(str.maketrans(UPPER, LOWER)).split()}
    assert "x" * 120_000 in {r.word for r in sv.counted_words(d, least_count=1).collect()}
    assert rows(sv.grouped_variants(sv.counted_words(d.where("false")))) == set()
    assert rows(sv.grouped_variants(sv.counted_words(d, least_count=1)))
