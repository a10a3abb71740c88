import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import byte_bpe

RANKS = byte_bpe.load_ranks()
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def as_library(text):
    return np.array(TRUE.encode_ordinary(text or ""), "<u4").tobytes()


def test_merge_equals_library():
    rng = random.Random(1)
    words = ["".join(rng.choice("abet hiノé😀") for _ in range(rng.randint(1, 300))).replace(" ", "") or "a" for _ in range(400)]
    for w in [*words, "a" * 5000, "ab" * 3000]:
        assert byte_bpe.merge(w.encode(), RANKS) == TRUE._core_bpe.encode_single_piece(w.encode())


def test_encode_and_decode_equal_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, buckets=16, block_chars=200_000)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert bytes(got[k].ids) == as_library(t) and bytes(got[k].bytes) == t.encode() and got[k].n_tokens == len(got[k].ids) // 4


def test_texts_are_cut_once(spark, sf_dir, monkeypatch):
    """Both uses of the cut texts read one shuffle, which sequences leave no more: two shuffles in all."""
    import re

    monkeypatch.setattr(byte_bpe, "SMALL", 1_000_000)
    out = byte_bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), block_chars=200_000)
    assert out.count() > 0
    df = out.groupBy().count()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "ReusedExchange" in final and len(re.findall(r"- Exchange hashpartitioning", final)) == 2


def test_edge_rows(spark):
    got = Counter((r.doc_id, bytes(r.ids)) for r in byte_bpe.encode(edge_docs(spark)).collect())
    assert got == Counter((r[0], as_library(r[1])) for r in ROWS)
    assert byte_bpe.digests(edge_docs(spark).limit(0)).count() == 0
    odd = [(1, "<|endoftext|> a\x00b 's'S  \x1c\x85 \n\n  x  ", "en", "a", 1)]
    assert bytes(byte_bpe.encode(edge_docs(spark, odd)).first().ids) == as_library(odd[0][1])
