"""Quality rules with host verdicts.

Each text is counted and judged by RULES. Each rule's failures are aggregated by host (documents: the source column), a host's
rate is shrunk by a beta prior fitted to all hosts' rates of that rule, and hosts whose lower posterior bound passes a limit
for any rule are rejected with all their documents. The rules in BASE also reject a document by themselves.

Null text counts as empty. Documents without a host are judged by the base rules alone. Repeated rows are judged alike and
count each. A text of any length is counted whole, in one row's expressions; its words take some 50 bytes of memory each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import BLANK_RE, BLANKS, beta_strength, join_by_key, packed, stored, table, words_of

SYMBOLS = "#*$%&|<>"
#: What fails a text, over its counts; the same text in Spark and in DuckDB.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "lines": "100 * n_dup_lines > 50 * n_lines",
    "letters": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repeated")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Low bits of a sort key hold a window's place in the text: 30 bits number the words of any string Spark can hold.
PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
PLACE = "_partition"


def _keys(words: Column) -> Column:
    """For each 3-word window a long: high bits of its hash, then its place. A primitive array sorts fast."""
    at = lambda i, k: F.get(words, i + F.lit(k))
    key = lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long"))
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)).otherwise(F.array().cast("array<bigint>"))


def _same_hash(a: Column, b: Column) -> Column:
    return F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, i + 1, 3))


def _neighbours(sorted_: Column) -> Column:
    """Elements whose window hash equals that of the element before or after."""
    return F.filter(sorted_, lambda x, k: _same_hash(x, F.get(sorted_, k - 1)) | _same_hash(x, F.get(sorted_, k + 1)))


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows that start at these ascending places."""
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, k + 1) - p, F.lit(3).cast("long"))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """df plus `counts`, a struct of COUNTS, and the partition's number.

    All of it is built-in expressions on the row: no shuffle. Repeated windows are found by sorting hashes; where two
    different windows share a hash, the windows' own strings are sorted instead, so the count is exact."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    d = df.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines)
    d = d.withColumn("_sorted", F.sort_array(_keys(F.col("_words"))))
    d = d.withColumn("_near", _neighbours(F.col("_sorted"))).drop("_sorted")
    w, near = F.col("_words"), F.col("_near")
    place = lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int")
    clash = F.exists(
        F.transform(near, lambda x, k: _same_hash(x, F.get(near, k - 1)) & (_window(w, place(x)) != _window(w, place(F.get(near, F.greatest(k - 1, F.lit(0))))))),
        lambda x: x,
    )
    slow_sorted = F.array_sort(F.transform(near, lambda x: F.struct(_window(w, place(x)).alias("s"), place(x).cast("long").alias("i"))))
    slow = F.transform(
        F.filter(
            slow_sorted,
            lambda x, k: F.coalesce(x["s"] == F.get(slow_sorted, k - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(slow_sorted, k + 1)["s"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    fast = F.transform(near, lambda x: x.bitwiseAND(F.lit(PLACES)))
    d = d.withColumn("_places", F.when(F.size(near) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.when(clash, slow).otherwise(fast))))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_places")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    # the second column depends on the place, so no filter above is pushed below and multiplies these expressions
    return d.withColumns({"counts": counts, PLACE: F.spark_partition_id()}).drop("_words", "_lines", "_near", "_places")


def failures(d: DataFrame) -> DataFrame:
    """d(counts, ...) with the counts as columns, a boolean for each rule, and base_failed."""
    rest = [c for c in d.columns if c not in ("counts", PLACE)]
    # the filter on the place keeps later filters on the rules from being pushed below, where they would count again
    d = d.where(F.col(PLACE) >= 0).select(*rest, "counts.*")
    d = d.select("*", *[F.expr(rule).alias(name) for name, rule in RULES.items()])
    return d.withColumn("base_failed", F.expr(" OR ".join(BASE)))


def host_verdicts(judged: DataFrame, limit: float = 0.5, z: float = 1.64) -> DataFrame:
    """(host, n, host_bound, host_ok) from judged(host, <rules>): one row per host, n its documents, host_bound the greatest of its rules' bounds; the heavy rows are pre-aggregated where they lie."""
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES])
    hosts = stored(hosts)  # small, and used several times below
    moments = [x for r in RULES for x in (F.sum(r).alias(f"{r}_A"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_Q"))]
    s = hosts.agg(F.sum("n").alias("N"), F.count("*").alias("G"), *moments).where("N > 0")

    def prior(r: str) -> list[Column]:
        m = F.col(f"{r}_A") / F.col("N")
        return [m.alias(f"{r}_m"), beta_strength(F.col("N"), m, F.col(f"{r}_Q") / F.col("N") - m * m, F.col("G")).alias(f"{r}_k")]

    def bound(r: str) -> Column:
        mean = (F.col(r) + F.col(f"{r}_k") * F.col(f"{r}_m")) / (F.col("n") + F.col(f"{r}_k"))
        return mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col(f"{r}_k") + 1))

    # one row of priors; the verdicts are written, so that the planner knows whether they are small enough to broadcast
    return stored(hosts.join(F.broadcast(s.select(*[x for r in RULES for x in prior(r)]))).select("host", "n", F.greatest(*[bound(r) for r in RULES]).alias("host_bound")).withColumn("host_ok", F.col("host_bound") <= limit))


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_bound, n_lines, <rules>); host_bound is null without a host. Texts are counted once; the counts are kept in the shared folder."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    d = stored(failures(text_counts(d, "text").drop("text")))
    verdicts = host_verdicts(d)
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return join_by_key(d, verdicts, "host", "n").select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "host_bound", "n_lines", *RULES)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that host_rules keeps, all their columns unchanged. What the base rules keep is written once with its rules, and then filtered by host."""
    r = packed(docs).select("row", F.col(f"row.`{text_col}`").alias("text"), F.col(f"row.`{host_col}`").alias("host"))
    judged = failures(text_counts(r, "text").drop("text"))
    judged = stored(judged.select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", *RULES))
    good = judged.where("row is not null").select("row", "host", F.xxhash64(f"row.`{text_col}`").alias("spread"))
    return join_by_key(good, host_verdicts(judged), "host", "n", spread=["spread"]).where(F.coalesce("host_ok", F.lit(True))).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, and the bound of their host's worst rule to six places."""
    return host_rules(table(spark, sf_dir, "documents")).withColumn("host_bound", F.round("host_bound", 6))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rc AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS x(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK_RE}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rc.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rc USING (doc_id)),
b AS (SELECT *, {', '.join(f'({rule}) AS {name}' for name, rule in RULES.items())} FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, {', '.join(f'count_if({r})::DOUBLE AS {r}' for r in RULES)} FROM b WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n) AS total, count(*) AS g, {', '.join(f'sum({r}) / sum(n) AS {r}_m, sum({r} * {r} / n) AS {r}_q' for r in RULES)} FROM h),
p AS (SELECT {', '.join(f'{r}_m, least(greatest({r}_m * (1 - {r}_m) / greatest({r}_q / total - {r}_m * {r}_m - {r}_m * (1 - {r}_m) * g / total, 1e-9) - 1, 1.0), 1e6) AS {r}_k' for r in RULES)} FROM s),
e AS (SELECT source, n, {', '.join(f'({r} + {r}_k * {r}_m) / (n + {r}_k) AS {r}_e, {r}_k' for r in RULES)} FROM h, p),
v AS (SELECT source, greatest({', '.join(f'{r}_e - 1.64 * sqrt({r}_e * (1 - {r}_e) / (n + {r}_k + 1))' for r in RULES)}) AS bound FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(BASE)} AS base_failed,
  NOT ({' OR '.join(BASE)}) AND coalesce(bound <= 0.5, TRUE) AS kept, round(bound, 6) AS host_bound, n_lines, {', '.join(RULES)}
FROM b LEFT JOIN v USING (source)"""
