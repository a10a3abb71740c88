"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is built-in expressions on the row, so a scan of the texts is the whole job: no shuffle. Texts without the
characters that a kind needs skip its expression. Patterns are written with possessive quantifiers and anchored at the start
of a run, which gives the same leftmost matches as the plain forms but keeps long runs linear and free of deep recursion.
Spans know their byte offsets as well: bytes are cut out at any offset at once, whereas code points are counted from the start
of the text, which would make many spans in a long text cost their number times its length.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import packed, table

#: Long arrays are summed in chunks, so that appending to an array stays cheap.
CHUNK = 256
#: (kind, pattern, a character without which nothing matches, base score, score with a context word near)
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "tax id"),
}
NEAR = 40  # code points before a span that are searched for context words
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double,from_byte:int,to_byte:int>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _starts(lengths: Column, first: Column) -> Column:
    """Exclusive running sums of an int array, beginning at `first`."""
    zero = F.struct(first.alias("s"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")), lambda acc: acc["a"])


def _with(value: Column, use) -> Column:
    """use(value), where the value is worked out once, however often and in whatever inner function it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prefix(lengths: Column) -> Column:
    def of(own: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(own, c * CHUNK + 1, CHUNK))
        return _with(chunks, lambda cs: F.flatten(F.transform(F.arrays_zip(cs.alias("c"), _starts(F.transform(cs, _sum), F.lit(0)).alias("s")), lambda z: _starts(z["c"], z["s"]))))

    return _with(lengths, of)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.reverse(number)
    each = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.substring(d, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    return _sum(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97 after moving its first four characters to the end."""
    s = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, m: Column) -> Column:
    d = digits(m)
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, r"\."), _small),
        "card": F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False),
        "phone": F.length(d).between(10, 15),
        "iban": F.when(F.length(F.replace(m, F.lit(" "))).between(15, 34), mod97(F.replace(m, F.lit(" ")))).otherwise(False),
        "ssn": ~m.startswith("000") & ~m.startswith("666") & ~m.startswith("9"),
    }[kind]


def _spans(text: Column, rank: int, kind: str, pattern: str, possible: Column) -> Column:
    """The pieces between matches, from split, and the matches together give every match's place."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def located(both: Column) -> Column:
        h, p, raw = both["h"], both["p"], both["raw"]

        def starts(size) -> Column:
            """Each match's offset, where size measures strings: the exclusive sums of what stands before."""
            return _prefix(F.transform(h, lambda m, i: size(m) + size(F.get(p, i))))

        rows = F.transform(
            F.arrays_zip(starts(F.length).alias("c"), starts(F.octet_length).alias("b")),
            lambda z, i: F.struct((z["c"] + F.length(F.get(p, i))).alias("start"), (z["b"] + F.octet_length(F.get(p, i))).alias("from"), F.get(h, i).alias("m")),
        )
        return F.transform(
            F.filter(rows, lambda r: _valid(kind, r["m"])),
            lambda r: F.struct(
                r["start"].alias("start"),
                F.lit(rank).alias("rank"),
                (r["start"] + F.length(r["m"])).alias("end"),
                F.lit(kind).alias("kind"),
                _score(raw, kind, r["from"]).alias("score"),
                r["from"].alias("from_byte"),
                (r["from"] + F.octet_length(r["m"])).alias("to_byte"),
            ),
        )

    none = F.array().cast(SPAN)
    both = F.struct(hits.alias("h"), pieces.alias("p"), text.cast("binary").alias("raw"))
    return F.when(possible, _with(both, lambda b: F.when(F.size(b["h"]) == 0, none).otherwise(located(b)))).otherwise(none)


def _score(raw: Column, kind: str, start: Column) -> Column:
    """The kind's score, higher if a context word stands in the NEAR code points before byte `start`, which take at most 4 bytes each."""
    width = F.least(start, F.lit(4 * NEAR))
    before = F.lower(F.right(F.substring(raw, start - width + 1, width).cast("string"), F.lit(NEAR)))
    near = F.exists(F.array(*[F.lit(w) for w in CONTEXT[kind]]), lambda w: F.contains(before, w))
    return F.lit(SCORES[kind]) + F.when(near, (1 - SCORES[kind]) * 0.75).otherwise(0.0)


def find_pii(text: Column, min_score: float = 0.5) -> Column:
    """Array of struct(start, rank, end, kind, score, from_byte, to_byte) by start, then kind.

    Base kinds (email, ip, card, phone) that pass their checks always stay. Account numbers must pass mod-97, and the
    identity numbers, which have no checksum, need a context word to reach min_score."""
    t = F.coalesce(text, F.lit(""))
    digit = t.rlike("[0-9]")
    found = [
        _spans(t, 0, "email", EMAIL, F.contains(t, F.lit("@"))),
        _spans(t, 1, "ip", IP, digit & F.contains(t, F.lit("."))),
        _spans(t, 2, "card", CARD, digit),
        _spans(t, 3, "phone", PHONE, F.contains(t, F.lit("+")) & digit),
    ]
    more = [_spans(t, 4, "iban", IBAN, digit), _spans(t, 5, "ssn", SSN, digit & F.contains(t, F.lit("-")))]
    return F.array_sort(F.concat(*found, *[F.filter(x, lambda s: s["score"] >= min_score) for x in more]))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row for each row of docs; repeated rows stay repeated."""
    return docs.select(F.col(id_col).alias("doc_id"), find_pii(F.col(text_col)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each stretch that spans cover replaced by [KIND], the kind of the span that begins it."""
    # overlapping spans count as one stretch; `out` alternates kept text and marks. Offsets are bytes, cut from `raw`
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def filled(b: Column) -> Column:
        raw, own = b["raw"], b["spans"]

        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(raw, acc["at"] + 1, F.greatest(s["from_byte"] - acc["at"], F.lit(0))).cast("string")
            mark = F.array(kept, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.struct(F.greatest(acc["at"], s["to_byte"]).alias("at"), F.when(s["from_byte"] >= acc["at"], F.concat(acc["out"], mark)).otherwise(acc["out"]).alias("out"))

        # spans go in chunks, each chunk's marks joined before the next, so that long lists stay cheap
        def chunk(acc: Column, c: Column) -> Column:
            done = F.aggregate(c, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)
            return _with(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

        chunks = F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(own, c * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, zero, chunk, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(raw, acc["at"] + 1, F.length(raw)).cast("string")))

    return F.when(F.size(spans) == 0, text).otherwise(_with(F.struct(text.cast("binary").alias("raw"), spans.alias("spans")), filled))


def mask_pii(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in the text and, where it has the column, n_chars set anew; other columns unchanged.

    Null texts stay null."""
    r = packed(docs).withColumn("spans", find_pii(F.col(f"row.{text_col}")))
    r = r.withColumn("masked", F.when(F.col(f"row.{text_col}").isNotNull(), masked(F.col(f"row.{text_col}"), F.col("spans"))))
    swap = {text_col: F.col("masked")}
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        swap[count_col] = F.when(F.size("spans") > 0, F.length("masked").cast(kind)).otherwise(F.col(f"row.{count_col}"))
    return r.select(*[swap.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii_spans(table(spark, sf_dir, "documents"))
    d = d.withColumn("base", F.filter("spans", lambda s: s["rank"] < len(BASE)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return d.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
