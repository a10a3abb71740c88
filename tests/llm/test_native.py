import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, edge_docs
from tiza.llm import mixing, pii, quality_rules, url_filter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, rx) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TEXTS = [
    "a.b+c@d-e.co.uk, x@y, z@w.q_r@s.t 1.2.3.4 001.2.3.255 256.1.1.1 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 22",
    "call +1 (555) 010-9999. fax +44 20 7946 0958 x +1 2",
    "😀é a@b.c 😀 10.0.0.1",
    "%a@b.c%d@e.f@g.h.i",
    " ".join(f"u{i}@h{i}.org" for i in range(700)),
]


def test_pii_base_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string"))
    got = {r.doc_id: [tuple(s)[:4] for s in r.spans if s["rank"] < 4] for r in pii.pii_spans(docs).collect()}
    want = {r.doc_id: base_spans(r.text) for r in docs.collect()}
    assert got == want and sum(map(len, want.values())) > 750


def test_pii_query_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, sf_dir).collect():
        b = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == i for x in b) for i in range(4))


def test_pii_checksums_and_context(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "DE89370400440532013001"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == ["iban"] and "iban" not in got[2] and got[3] == ["ssn"] and got[4] == []


def test_pii_masks(spark):
    many = " ".join(f"u{i}@h{i}.org" for i in range(700))
    docs = spark.createDataFrame([(1, "x a@b.c y 10.0.0.1", 18), (2, None, None), (3, "clean", 5), (4, many, len(many))], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in pii.mask_pii(docs).collect()}
    assert got[1].text == "x [EMAIL] y [IP]" and got[1].n_chars == 16
    assert got[2].text is None and got[3].text == "clean" and got[4].text == " ".join(["[EMAIL]"] * 700)


def test_pii_many_spans_in_one_text(spark):
    """Time goes with the text's length, not with its spans times its length."""
    import time

    text = " ".join(f"é mail u{i}@h{i}.org 10.0.{i % 256}.1" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint").repartition(1).cache()
    docs.count()
    pii.pii_spans(docs.withColumn("text", F.substring("text", 1, 300))).collect()
    began = time.time()
    spans = pii.pii_spans(docs).first().spans
    masked = pii.mask_pii(docs).first()
    assert time.time() - began < 60
    assert [tuple(s)[:4] for s in spans] == base_spans(text) and len(spans) == 40_000
    assert all(s.score > 0.9 for s in spans if s.kind == "email") and text.encode()[spans[9].from_byte : spans[9].to_byte].decode() == text[spans[9].start : spans[9].end]
    assert masked.text == " ".join(["é mail [EMAIL] [IP]"] * 20_000) and masked.n_chars == len(masked.text)


def test_pii_edge_rows(spark):
    d = edge_docs(spark)
    got = pii.pii_spans(d).collect()
    assert len(got) == len(ROWS) and sum(len(r.spans) for r in got) == sum(len(base_spans(r[1])) for r in ROWS)
    assert pii.mask_pii(d).columns == d.columns and pii.mask_pii(d).count() == len(ROWS)
    assert pii.mask_pii(d.limit(0)).collect() == []


def counts_of(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = [*ROWS, (7, "a b c a b c d a b\na b\nx\na b\n", "en", "a", 1), (8, "# $ % <a|b>&*", "en", "a", 1), (9, "a a a a", "en", "a", 1)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.host_rules(edge_docs(spark, rows)).collect())
    assert got == Counter((r[0], *counts_of(r[1])) for r in rows)


def test_quality_hash_clash_falls_back_to_strings(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_same_hash", lambda a, b: F.coalesce((a > F.lit(-(2**63))) == (b > F.lit(-(2**63))), F.lit(False)))  # all alike
    rows = [(7, "a b c d a b c e f a b c d", "en", "a", 1), (8, "a b c d e f", "en", "a", 1)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.host_rules(edge_docs(spark, rows)).collect()}
    assert got == {7: counts_of(rows[0][1])[4], 8: 0}


def test_quality_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "bad", 5) for i in range(60)] + [(100, good, "en", "bad", 1), (101, good, "en", None, 1)] + [(200 + i, good, "en", f"ok{i % 5}", 1) for i in range(100)]
    d = edge_docs(spark, rows)
    kept = {r.doc_id for r in quality_rules.host_rules(d).where("kept").collect()}
    assert kept == {101, *range(200, 300)}
    assert quality_rules.keep_good(d).columns == d.columns and {r.doc_id for r in quality_rules.keep_good(d).collect()} == kept
    assert quality_rules.keep_good(d.limit(0)).count() == 0 and quality_rules.host_rules(d.limit(0)).count() == 0


def test_quality_hosts_by_other_rules(spark):
    """A host whose documents mostly fail a rule that doesn't reject by itself goes as a whole."""
    words = [f"word{i}" for i in range(60)]
    odd = {"symbols": " ".join(f"{w}##" for w in words), "lines": "\n".join([" ".join(words), *["again"] * 20]), "letters": " ".join(w * 4 for w in words)}
    rows = [(1000 * k + i, text, "en", f"odd {name}", 1) for k, (name, text) in enumerate(odd.items()) for i in range(60)]
    rows += [(9000 + i, " ".join(words), "en", f"ok{i % 5}", 1) for i in range(200)]
    for name in odd:
        rows.append((8000, " ".join(words), "en", f"odd {name}", 1))
    got = quality_rules.host_rules(edge_docs(spark, rows)).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if r.kept} == set(range(9000, 9200))
    for k, name in enumerate(odd):
        assert all(r[name] and sum(r[x] for x in quality_rules.RULES) == 1 for r in got if 1000 * k <= r.doc_id < 1000 * k + 60)
    assert quality_rules.host_rules(edge_docs(spark)).count() == len(ROWS)


def test_url_rules_and_hosts(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://WWW.Example.com/en/1?x", "e"),
            (2, "http://m.example.com/en/1", "e"),
            (3, "http://a.net/fr/", "e"),
            (4, "http://a.net/en/", "e"),
            (5, None, "e"),
            (6, "no scheme", "e"),
            (7, "http://example.com", "e"),
            *[(10 + i, f"http://spam.org/{i}", "e") for i in range(40)],
            *[(100 + i, f"http://h{i % 9}.good.org/{i}", "e") for i in range(90)],
        ],
        "page_id bigint, url string, host string",
    )
    labels = spark.createDataFrame([(10 + i, 1) for i in range(30)] + [(100 + i, 0) for i in range(80)] + [(None, 1), (5, None), (7777, 1)], "page_id bigint, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict, got[3].verdict, got[4].rule, got[4].verdict) == ("example.com/en/", "block", "block", None, "allow")
    assert (got[5].host, got[5].path, got[6].host, got[6].verdict, got[7].path, got[7].rule) == ("", "", "", "allow", "", None)
    assert {got[10 + i].verdict for i in range(40)} == {"block"} and {got[100 + i].verdict for i in range(90)} == {"allow"}
    none = url_filter.filter_urls(pages, labels.limit(0))
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"} and url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_url_levels(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com:80", "y.x.com", "localhost", "10.0.0.1:8080", "10.0.1.1", "me.github.io", "[::1]", ""]
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in d.select("host", *[x.alias(n) for x, n in zip(url_filter._levels(F.col("host")), "ds", strict=True)]).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:80": ("x.com", "com"), "y.x.com": ("x.com", "com"), "localhost": ("localhost", "localhost"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "10.0.1.1": ("10.0.1.1", "10.0.1.1"), "me.github.io": ("me.github.io", "github.io"), "[::1]": ("[::1]", "[::1]"), "": ("", ""),
    }


def test_url_hosts_of_one_suffix_keep_apart(spark):
    """Sites under a two-label suffix have priors of their own; repeated pages and labels count each."""
    pages = [(i, f"http://h{i}.bad.co.uk/") for i in range(60)] + [(100 + i, f"http://h{i}.good.co.uk/") for i in range(60)]
    pages += [(200, "http://new.bad.co.uk/"), (201, "http://new.good.co.uk/"), (201, "http://new.good.co.uk/"), (0, "http://h0.bad.co.uk/")]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(0, 1)]
    d = spark.createDataFrame(pages, "page_id bigint, url string")
    got = url_filter.filter_urls(d, spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert len(got) == len(pages) and {r.verdict for r in got if ".bad." in r.host} == {"block"} and {r.verdict for r in got if ".good." in r.host} == {"allow"}


def edf(shares, slots):
    """The schedule by brute force."""
    k, out = dict.fromkeys(shares, 0), []
    for t in range(slots):
        due = [(-(-(k[s] + 1) * slots // a), -a, s) for s, a in sorted(shares.items()) if k[s] * slots // a <= t]
        s = min(due)[2]
        out.append(s)
        k[s] += 1
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 7}, {"a": 33, "b": 1, "c": 1, "d": 5}, {"a": 50, "b": 50}, {f"s{i:02}": 1 + i % 3 for i in range(40)}])
def test_schedule_is_pfair(spark, shares):
    slots = sum(shares.values())
    plan = mixing.schedule(spark.createDataFrame(sorted(shares.items()), "src string, a bigint"), slots).collect()
    got = sorted((t, r.src) for r in plan for t in r.places)
    assert [s for _, s in got] == edf(shares, slots) and [t for t, _ in got] == list(range(slots))
    seen = Counter()
    for t, s in got:
        seen[s] += 1
        assert all(abs(Fraction(a * (t + 1), slots) - seen[x]) < 1 for x, a in shares.items())


def test_mix_keeps_all_rows_and_shares(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else ("small" if i % 2 else None), 1) for i in range(900)]
    d = edge_docs(spark, rows + rows[:3])
    got = mixing.mix(d, weights={"big": 50, "small": 30, "": 20}, slots=100, block=4, piece=50).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in rows + rows[:3])
    by = defaultdict(list)
    for r in got:
        by[r.src].append((r.slot, r.offset, hashlib.md5(str(r.row.doc_id).encode()).hexdigest()))
    for s, x in by.items():
        assert [k for *_, k in sorted(x)] == sorted(k for *_, k in x)
        assert len({y[:2] for y in x}) == len(x) and {y[1] for y in x} <= set(range(4))
    assert len({(r.slot, r.offset) for r in got}) == len(got)
    assert mixing.mixed_order(d, slots=100).columns == d.columns and mixing.mixed_order(d.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(d, weights={"big": 1000}).collect()


def test_mix_edge_rows(spark):
    assert mixing.mixed_order(edge_docs(spark)).count() == len(ROWS)


def test_many_sources_are_within_one_block(spark):
    """More sources than slots, a hot one among them; every source at every slot."""
    counts = {f"s{i}": 4 + i % 5 for i in range(1100)} | {"big": 2200}
    plan, q = mixing._plan(spark.createDataFrame(sorted(counts.items()), "src string, n bigint"), mixing.SLOTS)
    plan = {r.src: r for r in plan.collect()}
    assert q == 20 * 1101 == sum(r.a for r in plan.values()) and sorted(t for r in plan.values() for t in r.places) == list(range(q))
    total = sum(n**0.7 for n in counts.values())
    for s, r in plan.items():
        assert r.a == len(r.places) and abs(r.a - q * counts[s] ** 0.7 / total) < 2 + q * counts[s] ** 0.7 / total / mixing.FINE
        # k blocks before the slot of block k and k + 1 after it, so these are where the deviation is greatest
        assert all(k * q - r.a * t < q and r.a * t - k * q < q and (k + 1) * q - r.a * (t + 1) < q for k, t in enumerate(r.places))


@pytest.mark.parametrize("n", [300, 900])
def test_equal_sources_get_equal_shares(spark, n):
    shares = mixing._plan(spark.createDataFrame([(f"s{i}", 50) for i in range(n)], "src string, n bigint"), mixing.SLOTS)[0].collect()
    assert len(shares) == n and max(r.a for r in shares) - min(r.a for r in shares) <= 0.05 * min(r.a for r in shares)


def test_mix_more_sources_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SENT", 10)
    rows = [(i, "t", "en", f"s{i % 110}" if i % 3 else "big", 1) for i in range(3300)]
    got = mixing.mix(edge_docs(spark, rows), block=1, piece=100).select("row.doc_id", "src", "slot", "offset").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({(r.slot, r.offset) for r in got}) == len(got) and all(r.slot >= 0 for r in got)


def test_rows_without_ids_spread(spark, tmp_path):
    """Null, equal and distinct ids of one source: numbers without gaps, in small pieces, in an order that stays."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 10 = 0 THEN 'a' END AS source")
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    mixed = mixing.mix(docs, piece=500, block=1)
    got = mixed.select("row.doc_id", "src", "slot").collect()
    assert len({r.slot for r in got}) == 30_000 and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.slot):
        by[r.src].append(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest())
    assert all(k == sorted(k) for k in by.values()) and len(by[""]) == 27_000
    r = mixing.placed(docs).select(F.lit("x").alias("src"), "row", F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).alias("key"), F.xxhash64("row", "file", "place").alias("tie"))
    counts = r.groupBy("src").agg(F.count("*").alias("n"))
    assert sorted(x["at"] for x in mixing._numbered(r, counts, 1, 500).collect()) == list(range(30_000))
    assert mixing._cut(r, counts, 1, 500).groupBy("src", "piece").count().agg(F.max("count")).first()[0] < 1000
