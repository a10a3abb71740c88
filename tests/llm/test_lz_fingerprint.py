import hashlib
import random
from collections import Counter

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import lz_fingerprint as lz


def plain_phrases(data):
    seen, i = set(), 0
    while i < len(data):
        j = i + 1
        while j <= len(data) and data[i:j] in seen:
            j += 1
        if j <= len(data):
            seen.add(data[i:j])
        i = j
    return seen


def test_phrases_equal_brute_force():
    rng = random.Random(3)
    for n in [*range(40), 500, 3000]:
        for alphabet in ("a", "ab", "abcdefgh é"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            seen = set()
            lz.phrases(t.encode(), seen)
            assert seen == plain_phrases(t.encode())
            other = "".join(rng.choice(alphabet) for _ in range(n))
            a, b, sha = lz.both_fingerprints(t, other)
            assert (a == lz.fingerprint(t)).all() and (b == lz.fingerprint(lz.edited(t, other))).all()
            assert sha == hashlib.sha256(lz.edited(t, other).encode()).hexdigest()


def expected(rows):
    # equal ids with different texts would go by Spark's own hash; there are none here
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = lz.edited(t, u)
        a, b, c = lz.fingerprint(t), lz.fingerprint(e), lz.fingerprint(u)
        out[i, len(t), hashlib.sha256(e.encode()).hexdigest(), lz.as_string(a), lz.as_string(b), lz.likeness(a, b), lz.likeness(a, c)] += 1
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = lz.edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"), bucket_rows=90).collect()
    assert Counter(map(tuple, got)) == expected(rows)
    near = sum(r.near_edited for r in got) / len(got)
    assert near > 0.45 > 0.3 > sum(r.near_next for r in got) / len(got)


def test_edge_rows(spark):
    assert Counter(map(tuple, lz.edited_likeness(edge_docs(spark), bucket_rows=2).collect())) == expected([r[:2] for r in ROWS])
    assert lz.edited_likeness(edge_docs(spark).limit(0)).collect() == []
    one = lz.edited_likeness(edge_docs(spark, ROWS[4:5])).collect()
    assert [r.near_next for r in one] == [1.0]
    assert lz.fingerprints(edge_docs(spark)).count() == len(ROWS)


def test_equal_and_missing_ids_are_cut_into_ranges(spark):
    """Rows that share an id, or have none, are dealt to many ranges; equal rows are one another's next."""
    from pyspark.sql import functions as F

    rows = [(7, "one text", "en", "s", 1)] * 120 + [(None, f"text {i} of many", "en", "s", 1) for i in range(120)] + [(9, "first", "en", "s", 1), (-(2**63), "least", "en", "s", 1)]
    ordered = lz._in_order(edge_docs(spark, rows), 20, "doc_id", "text")
    sizes = Counter(r.bucket for r in ordered.where("not borrowed").collect())
    assert len(sizes) > 6 and max(sizes.values()) < 80 and sum(sizes.values()) == len(rows)
    got = lz.edited_likeness(edge_docs(spark, rows), bucket_rows=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    a, b = lz.fingerprint("one text"), lz.fingerprint("least")
    assert Counter(r.near_next for r in got if r.doc_id == 7) == Counter({1.0: 119, lz.likeness(a, b): 1})
    hashes = {r.text: r.h for r in edge_docs(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted((r[1] for r in rows if r[0] is None), key=lambda t: -hashes[t])
    shas = [hashlib.sha256(lz.edited(t, u).encode()).hexdigest() for t, u in zip(order, [*order[1:], "first"], strict=True)]
    assert Counter(r.edited_sha256 for r in got if r.doc_id is None) == Counter(shas)


def test_likeness():
    a = lz.fingerprint("the quick brown fox jumps over the lazy dog " * 20)
    assert lz.likeness(a, a) == 1 and lz.likeness(lz.fingerprint(""), lz.fingerprint(None)) == 1 and lz.likeness(a, lz.fingerprint("")) == 0
