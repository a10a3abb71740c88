"""Queries over the driver's tables and the equivalent SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from tiza.functions import checks, dates, json_repair, numeric, text
from tiza.operators import batching, evaluate, fuzzy_join, ledger, merge, names, omr, parse, scoring, validated
from tiza.operators.dedupe import first_of_each, first_wins
from tiza.operators.lineage import new_folder
from tiza.sources import readers, sinks
from tiza.sources.lines import growing_lines
from tiza.sources.readers import joined_pages, table
from tiza.streaming import completion, state

QUERIES: dict = {}
ORACLES: dict = {}

ANSWER_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ANSWER_SQL = ", ".join(ANSWER_ORDER)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _grade_sql(score: str, maximum: str, pct: str = "60.0") -> str:
    ap = f"ceil({maximum} * (least(100.0::DOUBLE, {pct}::DOUBLE) / 100))"
    s = f"greatest(0.0::DOUBLE, {score})"
    raw = f"CASE WHEN {s} = 0 THEN 1.0::DOUBLE WHEN {s} <= {ap} THEN least(4.0::DOUBLE, 1.0::DOUBLE + 3.0::DOUBLE * {s} / nullif({ap}, 0)) WHEN {maximum} = {ap} THEN 7.0::DOUBLE ELSE 4.0::DOUBLE + 3.0::DOUBLE * ({s} - {ap}) / nullif({maximum} - {ap}, 0) END"
    return f"CASE WHEN {maximum} <= 0 THEN 1.0::DOUBLE ELSE least(7.0::DOUBLE, floor(({raw}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) END"


def _gradebook(spark: SparkSession, d: str) -> DataFrame:
    """One graded exam per order: line items are answers, the line number is an answer's worth, flag N is right."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *ANSWER_ORDER, "l_returnflag")
    a = a.select("l_orderkey", F.col("l_linenumber").alias("question"), *ANSWER_ORDER, F.col("l_returnflag").alias("given"), F.lit("N").alias("right"), F.col("l_linenumber").cast("long").alias("max_score"))
    return scoring.graded(scoring.closed_score(a, ["l_orderkey"], ANSWER_ORDER))


_SCORES = f"""SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END)::BIGINT AS score, sum(l_linenumber)::BIGINT AS max_score
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ANSWER_SQL}, l_returnflag) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1"""
_GRADED = f"SELECT *, ceil(max_score * 0.6::DOUBLE)::BIGINT AS pass_points, {_grade_sql('score::DOUBLE', 'max_score::DOUBLE')} AS grade FROM ({_SCORES})"


@query(
    "gradebook",
    f"""SELECT l_orderkey, c_custkey, c_name, score, max_score, pass_points, grade FROM ({_GRADED}) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""",
)
def gradebook(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name")
    j = _gradebook(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("l_orderkey", "c_custkey", "c_name", "score", "max_score", "pass_points", "grade")


@query(
    "grade_velocimeter",
    f"""SELECT l_orderkey, least(100.0::DOUBLE, 100.0::DOUBLE * score / nullif(max_score, 0)) AS percent, least(100.0::DOUBLE, 100.0::DOUBLE * pass_points / nullif(max_score, 0)) AS percent_pass,
    score >= pass_points AS approved FROM ({_GRADED})""",
)
def grade_velocimeter(spark, d):
    m = F.col("max_score").cast("double")
    return _gradebook(spark, d).select("l_orderkey", numeric.percent(F.col("score"), m).alias("percent"), numeric.percent(F.col("pass_points"), m).alias("percent_pass"), (F.col("score") >= F.col("pass_points")).alias("approved"))


@query(
    "grade_variants",
    f"""WITH s AS (SELECT l_orderkey, score::DOUBLE AS s, max_score::DOUBLE AS m, max_score * 60.0::DOUBLE / 100 AS ap, grade FROM ({_GRADED}))
    SELECT l_orderkey, floor(greatest(1.0::DOUBLE, least(7.0::DOUBLE, CASE WHEN s >= ap THEN 4.0::DOUBLE + CASE WHEN m - ap > 0 THEN (s - ap) / nullif(m - ap, 0) ELSE 0.0::DOUBLE END * 3.0::DOUBLE
      ELSE 1.0::DOUBLE + CASE WHEN ap > 0 THEN s / nullif(ap, 0) ELSE 0.0::DOUBLE END * 3.0::DOUBLE END)) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS unceiled, grade + 0.3::DOUBLE AS with_tenths FROM s""",
)
def grade_variants(spark, d):
    s, m = F.col("score").cast("double"), F.col("max_score").cast("double")
    return _gradebook(spark, d).select("l_orderkey", numeric.grade_unceiled(s, m, F.lit(60.0)).alias("unceiled"), numeric.final_grade(F.col("grade"), F.lit(0.3)).alias("with_tenths"))


@query(
    "stats_by_area",
    f"""SELECT c_mktsegment AS area, count(*)::BIGINT AS n, count_if(score >= pass_points)::BIGINT AS approved, sum(score)::BIGINT AS points, min(grade) AS lowest, max(grade) AS highest
    FROM ({_GRADED}) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def stats_by_area(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("area"))
    j = _gradebook(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("pass_points")).alias("approved"), F.sum("score").alias("points"), F.min("grade").alias("lowest"), F.max("grade").alias("highest"))


#: Part numbers of a sheet.
SHEET = 200


def _sheets(spark, d) -> DataFrame:
    """A score sheet for each brand and block of part numbers: development items where the size is a multiple of five."""
    item = F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("P")).otherwise("SM"), F.col("p_partkey").cast("string"), F.lit(":"), F.col("p_size").cast("string"))
    p = table(spark, d, "part").select("p_brand", F.floor(F.col("p_partkey") / SHEET).alias("block"), "p_partkey", item.alias("item"))
    return joined_pages(p, ["p_brand", "block"], "p_partkey", "item", "; ").select("p_brand", "block", F.col("text").alias("sheet"))


_ITEMS = f"""SELECT p_brand, block, pos, trim(split_part(pair, ':', 1)) AS id, trim(split_part(pair, ':', 2))::INT AS max_score FROM (
  SELECT p_brand, block, unnest(string_split(sheet, ';')) AS pair, unnest(range(len(string_split(sheet, ';'))))::INT AS pos FROM (
    SELECT p_brand, (p_partkey // {SHEET})::BIGINT AS block, string_agg((CASE WHEN p_size % 5 = 0 THEN 'P' ELSE 'SM' END) || p_partkey || ':' || p_size, '; ' ORDER BY p_partkey) AS sheet FROM part GROUP BY 1, 2))"""


_WHOLE_ITEMS = """SELECT p_brand, pos, trim(split_part(pair, ':', 1)) AS id, trim(split_part(pair, ':', 2))::INT AS max_score FROM (
  SELECT p_brand, unnest(string_split(sheet, ';')) AS pair, unnest(range(len(string_split(sheet, ';'))))::INT AS pos FROM (
    SELECT p_brand, string_agg((CASE WHEN p_size % 5 = 0 THEN 'P' ELSE 'SM' END) || p_partkey || ':' || p_size, '; ' ORDER BY p_partkey) AS sheet FROM part GROUP BY 1))"""


@query("score_sheet_parse", f"SELECT *, starts_with(id, 'P') AS is_development FROM ({_WHOLE_ITEMS}) WHERE max_score > 0")
def score_sheet_parse(spark, d):
    """A brand's whole sheet, which comes in pieces."""
    return parse.score_sheet_pieces(_sheets(spark, d), ["p_brand"], "block", "sheet").select("p_brand", "pos", "id", "max_score", "is_development")


@query(
    "max_reconcile",
    f"""SELECT p_brand AS sheet_of, block, sum(CASE WHEN starts_with(id, 'P') THEN 0 ELSE max_score END)::BIGINT AS closed_max, sum(CASE WHEN starts_with(id, 'P') THEN max_score ELSE 0 END)::BIGINT AS development_max,
    sum(max_score)::BIGINT AS item_max, sum(max_score)::BIGINT AS total_max FROM ({_ITEMS}) WHERE max_score > 0 GROUP BY 1, 2
    UNION ALL SELECT s_name, NULL, 0, 0, 0, CASE WHEN s_nationkey % 5 = 0 THEN 100 ELSE s_nationkey END FROM supplier""",
)
def max_reconcile(spark, d):
    """The items' sum for each sheet; and, for suppliers, whose sheets have no items, the total they declare (the nation's number, 0 where 5 divides it), or 100 where that is 0."""
    own = scoring.maximum(parse.score_sheet(_sheets(spark, d), "sheet"), ["p_brand", "block"], F.lit(60).cast("long")).withColumnRenamed("p_brand", "sheet_of")
    none = F.lit(0).cast("long")
    declared = F.when(F.col("s_nationkey") % 5 == 0, 0).otherwise(F.col("s_nationkey")).cast("long")
    bare = table(spark, d, "supplier").select(F.col("s_name").alias("sheet_of"), F.lit(None).cast("long").alias("block"), *[none.alias(c) for c in ("closed_max", "development_max", "item_max")], scoring.reconciled(none, declared).alias("total_max"))
    return own.unionByName(bare)


@query(
    "answer_key_map",
    f"""SELECT p_brand, (p_partkey // {SHEET})::BIGINT AS block, 'Q' || (p_partkey % 7) AS id, upper(substr(arg_max(p_type, p_partkey), 1, 1)) AS answer FROM part GROUP BY 1, 2, 3""",
)
def answer_key_map(spark, d):
    pair = F.concat(F.lit("Q"), (F.col("p_partkey") % 7).cast("string"), F.lit(": "), F.upper(F.substring("p_type", 1, 1)))
    p = table(spark, d, "part").select("p_brand", F.floor(F.col("p_partkey") / SHEET).alias("block"), "p_partkey", pair.alias("pair"))
    return parse.answer_key(joined_pages(p, ["p_brand", "block"], "p_partkey", "pair", ";"), ["p_brand", "block"], "text")


_QID = "CASE doc_id % 4 WHEN 0 THEN 'SM1' WHEN 1 THEN 'VF2' WHEN 2 THEN 'TP3' ELSE 'X' END"
_NORM = f"""SELECT doc_id, q, CASE WHEN t = '' THEN 'SIN_RESPUESTA:low'
  WHEN q = 'SM1' AND regexp_matches(t, '^[A-E][ \\t\\n\\r\\f\\x0b):(.]') THEN t[1] || ':high'
  WHEN q = 'SM1' AND regexp_matches(t, '^[A-E]') THEN t[1] || CASE WHEN length(t) > 1 THEN ':low' ELSE ':high' END
  WHEN q = 'VF2' AND regexp_matches(t, '^[VF]') THEN t[1] || CASE WHEN length(t) > 1 THEN ':low' ELSE ':high' END
  WHEN q = 'TP3' AND regexp_matches(t, '[0-9]') THEN regexp_extract(t, '([0-9]+)', 1) || ':high'
  WHEN regexp_matches(t, '^([A-F]|[0-9])') THEN regexp_extract(t, '^([A-F]|[0-9]+)', 1) || ':low' ELSE 'SIN_RESPUESTA:low' END AS r
  FROM (SELECT doc_id, {_QID} AS q, upper(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')) AS t FROM documents)"""


def _normalised(spark, d) -> DataFrame:
    k = F.col("doc_id") % 4
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(k == 0, "SM1").when(k == 1, "VF2").when(k == 2, "TP3").otherwise("X").alias("q"))
    return docs.select("doc_id", "q", text.normalise_answer(F.col("text"), F.col("q"), F.lit(None).cast("string")).alias("a"))


@query("answer_normalise", f"SELECT doc_id, split_part(r, ':', 1) AS answer, split_part(r, ':', 2) AS confidence FROM ({_NORM})")
def answer_normalise(spark, d):
    return _normalised(spark, d).select("doc_id", F.col("a.text").alias("answer"), F.col("a.confidence").alias("confidence"))


@query(
    "needs_review",
    f"""SELECT doc_id, a <> 'A' OR length(a) > 2 OR (q = 'VF2' AND a NOT IN ('V', 'F')) OR (q = 'TP3' AND NOT regexp_matches(a, '^[+-]?[0-9]')) OR (q = 'SM1' AND a NOT IN ('A', 'B', 'C', 'D', 'E')) AS review
    FROM (SELECT doc_id, q, split_part(r, ':', 1) AS a FROM ({_NORM}))""",
)
def needs_review(spark, d):
    return _normalised(spark, d).select("doc_id", text.needs_review(F.col("q"), F.col("a.text"), F.lit("A")).alias("review"))


_FUZZY = """SELECT p_partkey, q AS question, arg_min(id, far * 1000000 + pos) AS item_id, coalesce(arg_min(m, far * 1000000 + pos), 1)::INT AS item_max FROM (
  SELECT p_partkey, q, id, pos, m, CASE WHEN {far} THEN 0 ELSE 1 END AS far FROM (SELECT p_partkey, 'SM' || (p_partkey % 40) AS q FROM part)
  LEFT JOIN (SELECT 'SM' || n_nationkey AS id, n_nationkey AS pos, n_regionkey + 1 AS m FROM nation) ON contains(q, id) OR contains(id, q)) GROUP BY 1, 2"""


def _fuzzy(spark, d, compat):
    q = table(spark, d, "part").select("p_partkey", F.concat(F.lit("SM"), (F.col("p_partkey") % 40).cast("string")).alias("question"))
    i = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("SM"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_regionkey") + 1).alias("max_score"))
    return fuzzy_join.match_items(q, i, compat=compat)


@query("fuzzy_item_join", _FUZZY.format(far="id = q"))
def fuzzy_item_join(spark, d):
    return _fuzzy(spark, d, False)


@query("fuzzy_item_join_compat", _FUZZY.format(far="TRUE"))
def fuzzy_item_join_compat(spark, d):
    return _fuzzy(spark, d, True)


@query(
    "positional_zip",
    """WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) FILTER (role = 'user') AS u, list(text ORDER BY turn, text) FILTER (role <> 'user') AS a FROM conversations GROUP BY 1)
    SELECT conv_id, (i - 1)::INT AS pos, length(u[i])::INT AS asked, length(coalesce(a[i], ''))::INT AS answered FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM c)""",
)
def positional_zip(spark, d):
    c = table(spark, d, "conversations")
    own = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda s: s["text"])
    g = c.groupBy("conv_id").agg(own(F.col("role") == "user").alias("u"), own(F.col("role") != "user").alias("a"))
    z = g.select("conv_id", F.inline(merge.zipped(F.col("u"), F.col("a"))))
    return z.select("conv_id", "pos", F.length("right").alias("asked"), F.length("given").alias("answered"))


@query(
    "dev_points",
    """SELECT l_orderkey, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS strict, sum(n)::BIGINT AS lenient FROM (
    SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, floor(q)::BIGINT AS n, q % 2 = 0 AS ok FROM (
      SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) GROUP BY 1""",
)
def dev_points(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("n"))
    value = F.concat(F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, "/50").otherwise("/50 aprox."))
    detail = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("P"), F.col("l_linenumber").cast("string")), F.struct(value.alias("puntaje"), F.lit("").alias("cita_estudiante"), F.lit("").alias("justificacion")))))
    g = li.groupBy("l_orderkey").agg(detail.alias("detail"))
    return g.select("l_orderkey", scoring.development_points(F.col("detail")).alias("strict"), scoring.development_points_lenient(F.col("detail")).alias("lenient"))


def _entries(spark, d, debit: int) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_type") == "purchase", 10).otherwise(debit).cast("long").alias("delta"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    "ledger_balance",
    """SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 10 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance
    FROM events WHERE event_type IN ('purchase', 'click')""",
)
def ledger_balance(spark, d):
    return ledger.running_balance(_entries(spark, d, -1), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "balance")


@query(
    "ledger_idempotent",
    """SELECT user_id, sum(delta)::BIGINT AS balance FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 10 ELSE -1 END AS delta,
    row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k')::INT ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('purchase', 'click')) WHERE rn = 1 GROUP BY 1""",
)
def ledger_idempotent(spark, d):
    once = ledger.once_per_operation(_entries(spark, d, -1), ["user_id", "k"], ["ts", "event_id"])
    return ledger.balances(once, "user_id")


@query("free_grant", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, 10::BIGINT AS delta FROM events WHERE event_type = 'signup' GROUP BY 1")
def free_grant(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return ledger.grant_once(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "delta")


@query(
    "consume_reject",
    """WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 10 ELSE -15 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'click')),
    r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS balance, 0::BIGINT AS accepted, 0::BIGINT AS rejected FROM e WHERE n = 1
      UNION ALL SELECT r.user_id, e.n, CASE WHEN balance + delta >= 0 THEN balance + delta ELSE balance END, accepted + (balance + delta >= 0)::INT, rejected + (balance + delta < 0)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, arg_max(balance, n) AS balance, max(accepted) AS accepted, max(rejected) AS rejected FROM r GROUP BY 1""",
)
def consume_reject(spark, d):
    return ledger.consume(_entries(spark, d, -15), "user_id", ["ts", "event_id"])


@query(
    "latest_code",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 10 MINUTE > (SELECT max(ts) - INTERVAL 5 DAY FROM events) GROUP BY 1""",
)
def latest_code(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("created_at"), F.expr("ts + INTERVAL 10 MINUTES").alias("expires_at"), (F.col("event_type") == "error").alias("used"))
    as_of = table(spark, d, "events").agg(F.expr("max(ts) - INTERVAL 5 DAYS").alias("as_of"))  # one row
    return merge.latest_valid(e.join(F.broadcast(as_of)), "user_id", F.col("as_of")).select("user_id", "event_id")


@query("history_by_student", "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS entry FROM orders")
def history_by_student(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return o.withColumn("entry", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).drop("o_orderdate")


_BIGRAMS = "list_transform(range(1, length({0})), lambda i: {0}[i:i + 1])"
_TOP3 = f"""WITH n AS (SELECT row_number() OVER (ORDER BY name) - 1 AS pos, name, replace(name, ' ', '') AS b FROM (SELECT DISTINCT p_name AS name FROM part)),
t AS (SELECT DISTINCT p_name AS text, replace(p_name, ' ', '') AS b FROM part),
nb AS (SELECT name, g, row_number() OVER (PARTITION BY name, g) AS k FROM (SELECT name, unnest({_BIGRAMS.format('b')}) AS g FROM n)),
tb AS (SELECT text, g, row_number() OVER (PARTITION BY text, g) AS k FROM (SELECT text, unnest({_BIGRAMS.format('b')}) AS g FROM t)),
c AS (SELECT text, name, count(*) AS c FROM tb JOIN nb USING (g, k) GROUP BY 1, 2),
r AS (SELECT t.text, n.name, n.pos, CASE WHEN t.b = n.b THEN 1.0::DOUBLE WHEN length(t.b) < 2 OR length(n.b) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(c.c, 0) / (length(t.b) + length(n.b) - 2) END AS s
  FROM t CROSS JOIN n LEFT JOIN c ON c.text = t.text AND c.name = n.name),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s DESC, pos) AS rn FROM r)
SELECT p_partkey, suggestions FROM part JOIN (SELECT text, string_agg(name, '|' ORDER BY rn) AS suggestions FROM k WHERE rn <= 3 GROUP BY 1) ON text = p_name"""


@query("name_top3", _TOP3)
def name_top3(spark, d):
    part = table(spark, d, "part")
    roll = part.select(F.col("p_name").alias("pos"), F.col("p_name").alias("name")).distinct()  # in the order of names
    out = names.top_names(part.select("p_partkey", F.col("p_name").alias("text")), roll)
    return out.select("p_partkey", F.array_join("suggestions", "|").alias("suggestions"))


_VALID = {"name": "o.name <> ''", "price": "o.price >= 0", "credits": "o.credits > 0"}


@query(
    "plan_merge",
    """WITH b AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size AS credits FROM part WHERE p_partkey % 3 <> 0),
    o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'new ' || p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN -1.0::DOUBLE ELSE p_retailprice + 1 END AS price, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size + 1 END AS credits FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(o.id, b.id) AS id, coalesce(CASE WHEN o.name <> '' THEN o.name END, b.name) AS name, coalesce(CASE WHEN o.price >= 0 THEN o.price END, b.price) AS price, coalesce(CASE WHEN o.credits > 0 THEN o.credits END, b.credits) AS credits
    FROM b FULL JOIN o ON b.id = o.id""",
)
def plan_merge(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    base = p.where(k % 3 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("credits"))
    over = p.where(k % 2 == 0).select(
        k.alias("id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("new "), F.col("p_name"))).alias("name"),
        F.when(k % 7 == 0, -1.0).otherwise(F.col("p_retailprice") + 1).alias("price"),
        F.when(k % 4 == 0, 0).otherwise(F.col("p_size") + 1).alias("credits"),
    )
    return merge.overlay(base, over, "id", {n: F.expr(c) for n, c in _VALID.items()})


@query("patch_by_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 AND o_custkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def patch_by_id(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") * 2).alias("o_totalprice"))
    return merge.patch(o, changes, "o_orderkey").drop("o_custkey")


@query("upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return merge.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).drop("event_id")


@query("delete_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_anti(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@query("two_step_lookup", "SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def two_step_lookup(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return merge.two_steps(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name", "found")


@query("batch_chunks", "SELECT event_id, n AS item_no, n // 45 AS chunk_no, n // 135 AS wave_no FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)")
def batch_chunks(spark, d):
    return batching.chunked(table(spark, d, "events").select("event_id"), "event_id", [])


@query(
    "batch_progress",
    """SELECT event_id, c AS completed, s::BIGINT AS succeeded, (c - s)::BIGINT AS failed, (c - 1) // 45 + 1 AS batch, floor(100.0::DOUBLE * c / t + 0.5)::BIGINT AS percent FROM (
    SELECT event_id, count(*) OVER w AS c, sum((event_type <> 'error')::INT) OVER w AS s, (SELECT count(*) FROM events) AS t FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))""",
)
def batch_progress(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    r = batching.running(e, "event_id", [], {"completed": F.lit(1), "succeeded": (F.col("event_type") != "error").cast("int")})
    total = e.agg(F.count("*").alias("total"))  # one row
    c = F.col("completed")
    return r.join(F.broadcast(total)).select("event_id", c, "succeeded", (c - F.col("succeeded")).alias("failed"), (F.floor((c - 1) / batching.CHUNK) + 1).alias("batch"), numeric.progress(c, F.col("total")).alias("percent"))


@query(
    "json_defaults",
    """SELECT event_id, event_id % 4 IN (0, 1) AS usable, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::DOUBLE WHEN event_id % 4 = 1 THEN 0.0::DOUBLE END AS nota,
    CASE WHEN event_id % 4 < 2 THEN (event_id % 4 = 0)::INT END AS corrections, CASE WHEN event_id % 4 < 2 THEN 0 END AS skills, CASE WHEN event_id % 4 < 2 THEN '' END AS strengths FROM events""",
)
def json_defaults(spark, d):
    """Replies: whole ones, ones with empty feedback, ones without a score, and texts that are no JSON."""
    k, s = F.get_json_object("props", "$.k"), lambda x: F.lit(x)
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(s('{"puntaje":"1/2","nota":'), k, s(',"retroalimentacion":{"correccion_detallada":[{"seccion":"a","detalle":"b"}]}}')))
        .when(F.col("event_id") % 4 == 1, s('{"puntaje":"1/2","nota":"x","retroalimentacion":{}}'))
        .when(F.col("event_id") % 4 == 2, s('{"nota":3,"retroalimentacion":{}}'))
        .otherwise(s("no reply"))
    )
    e = table(spark, d, "events").select("event_id", json_repair.parsed(reply).alias("v")).select("event_id", json_repair.usable(F.col("v")).alias("usable"), json_repair.with_defaults(F.col("v")).alias("w"))
    own = lambda x: F.when(F.col("usable"), x)
    r = F.col("w.retroalimentacion")
    return e.select("event_id", "usable", own(F.col("w.nota")).alias("nota"), own(F.size(r["correccion_detallada"])).alias("corrections"), own(F.size(r["evaluacion_habilidades"])).alias("skills"), own(r["resumen_general"]["fortalezas"]).alias("strengths"))


@query("json_repair", "SELECT event_id, props AS json, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_repair_query(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Reply:\n```json\n"), F.col("props"), F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("noise "), F.col("props"), F.lit(" noise")))
    e = table(spark, d, "events").select("event_id", json_repair.cut_json(raw).alias("json"))
    return e.select("event_id", "json", F.from_json("json", "k int")["k"].alias("k"))


@query("html_strip", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), '^ | $', '', 'g') AS plain FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(
    "control_clean",
    "SELECT doc_id, sha256(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F]', '', 'g'), ' +', ' ', 'g'), '^ +| +$', '', 'g'), ''), '—')) AS digest FROM documents",
)
def control_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_control(F.col("text")), 256).alias("digest"))


@query(
    "feedback_prefix",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Estudiante ' || conv_id || ' ' || lower(text[1]) || text[2:] WHEN 1 THEN 'Ana Soto ana Soto muestra ' || text ELSE 'El estudiante ' || text END AS feedback FROM conversations""",
)
def feedback_prefix(spark, d):
    """A known name, a name that the text itself gives, and texts that speak of the student already."""
    t = F.col("turn") % 3
    known = F.when(t == 0, F.concat(F.lit("Estudiante "), F.col("conv_id").cast("string"))).otherwise("Estudiante")
    said = F.when(t == 0, F.col("text")).when(t == 1, F.concat(F.lit("Ana Soto muestra "), F.col("text"))).otherwise(F.concat(F.lit("El estudiante "), F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.prefixed_feedback(said, known).alias("feedback"))


@query("text_concat_pages", "SELECT conv_id, string_agg(text, chr(10) || '--- PAGE ---' || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def text_concat_pages(spark, d):
    return joined_pages(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", "\n--- PAGE ---\n")


@query(
    "omr_rows",
    """WITH RECURSIVE m AS (SELECT l_orderkey, l_linestatus, l_linenumber::DOUBLE AS x, l_quantity AS y, 1 - max(l_discount) AS c FROM lineitem GROUP BY ALL HAVING 1 - max(l_discount) >= 0.85::DOUBLE),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY y, x, c) AS n FROM m),
    f AS (SELECT l_orderkey, l_linestatus, n, x, y, c, [y] AS firsts, 1::BIGINT AS r FROM o WHERE n = 1
      UNION ALL SELECT o.l_orderkey, o.l_linestatus, o.n, o.x, o.y, o.c, CASE WHEN p > 0 THEN firsts ELSE list_append(firsts, o.y) END, CASE WHEN p > 0 THEN p ELSE len(firsts) + 1 END
      FROM (SELECT f.l_orderkey AS k, f.l_linestatus AS s, f.n + 1 AS nn, firsts, coalesce(list_position(list_transform(firsts, lambda v: abs(v - z.y) < 15), TRUE), 0) AS p FROM f JOIN o AS z ON z.l_orderkey = f.l_orderkey AND z.l_linestatus = f.l_linestatus AND z.n = f.n + 1)
      JOIN o ON o.l_orderkey = k AND o.l_linestatus = s AND o.n = nn),
    g AS (SELECT l_orderkey, l_linestatus, (r - 1)::INT AS row, count(*) AS marks, min(c) AS confidence, arg_min({'x': x, 'y': y}, (x, c, y)) AS a, arg_max({'x': x, 'y': y}, (x, c, y)) AS z FROM f GROUP BY ALL)
    SELECT l_orderkey, l_linestatus, row, 'P' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, row) AS id, CASE WHEN marks = 2 THEN 'true_false' ELSE 'multiple_choice' END AS type,
      ['A', 'B', 'C', 'D', 'E', 'F', 'G'][least(marks, 7)] AS value, confidence, a.x AS "left", a.y AS top, z.x + 1 - a.x AS width, z.y + 1 - a.y AS height FROM g""",
)
def omr_rows(spark, d):
    """An order is a sheet, its line states are its pages, and lines are marks."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("l_linenumber"), F.col("l_quantity")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber", "l_quantity").agg(F.max("l_discount").alias("disc"))
    mark = F.struct(F.lit("selected").alias("state"), (1 - F.col("disc")).alias("confidence"), F.array(p(x, y), p(x + 1, y), p(x + 1, y + 1)).alias("polygon"))
    items = omr.read_pages(li.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(mark).alias("marks")), ["l_orderkey"], "l_linestatus")
    return items.select("*", *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("left", "top", "width", "height"))]).drop("box")


@query(
    "mime_filter",
    """SELECT doc_id, urls, mime, mime = 'image/png' OR mime = 'application/pdf' AS readable, mime = 'image/png' AS photo FROM (
    SELECT doc_id, CASE lang WHEN 'en' THEN 'image/png' WHEN 'fr' THEN 'application/pdf' ELSE 'text/plain' END AS mime, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS urls FROM documents)""",
)
def mime_filter(spark, d):
    """Each document has a missing URL before its own: types stay with their URLs when empty ones drop out."""
    mime = F.when(F.col("lang") == "en", "image/png").when(F.col("lang") == "fr", "application/pdf").otherwise("text/plain")
    u = F.col("doc_id").cast("string")
    both = readers.with_types(F.array(F.when(F.col("doc_id") % 2 == 0, "").otherwise("x"), u), F.array(F.lit("video/mp4"), mime))
    m = table(spark, d, "documents").select("doc_id", both.alias("files")).select("doc_id", F.size("files").alias("urls"), F.element_at("files", -1)["mime"].alias("mime"))
    return m.select("doc_id", "urls", "mime", text.readable_type(F.col("mime")).alias("readable"), text.photo_type(F.col("mime")).alias("photo"))


# Exams: a region each, whose nations are the items; every fifth is a development item. An order is a student's answers.
_EXAM_ITEMS = "SELECT n_regionkey AS exam, n_nationkey AS pos, CASE WHEN n_nationkey % 5 = 0 THEN 'P' WHEN n_nationkey % 3 = 0 THEN 'VF' ELSE 'SM' END || n_nationkey AS id, n_nationkey % 4 + 1 AS worth, substr('ABCDEVF', n_nationkey % 7 + 1, 1) AS answer FROM nation"
_EXAM_ANSWERS = """SELECT l_orderkey % 5 AS exam, l_orderkey AS student, l_linenumber AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'SM' ELSE 'VF' END || l_partkey % 25 AS q,
    substr('ABCDEVF', l_suppkey::INT % 7 + 1, 1) AS given, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2, l_partkey % 25 ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem"""


def _exams(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    kind = F.when(k % 5 == 0, "P").when(k % 3 == 0, "VF").otherwise("SM")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("exam"), k.alias("pos"), F.concat(kind, k.cast("string")).alias("id"), (k % 4 + 1).cast("string").alias("worth"), F.substring(F.lit("ABCDEVF"), (k % 7 + 1).cast("int"), F.lit(1)).alias("answer"))
    text_of = lambda c: joined_pages(n.select("exam", "pos", F.concat_ws(":", "id", c).alias("t")), ["exam"], "pos", "t", "; ")
    return text_of("worth").withColumnRenamed("text", "sheet").join(text_of("answer").withColumnRenamed("text", "key"), "exam").withColumn("declared", F.lit(51).cast("long"))


def _exam_answers(spark, d) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    given = F.substring(F.lit("ABCDEVF"), (s % 7 + 1).cast("int"), F.lit(1))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("exam"), F.col("l_orderkey").alias("student"), F.struct("l_linenumber", "l_suppkey").alias("pos"),
        F.concat(F.when(p % 2 == 0, " sm").otherwise("VF"), (p % 25).cast("string")).alias("question"), given.alias("given"), F.lit("sm_vf").alias("mode"),
    )


@query(
    "evaluate_route",
    f"""WITH i AS ({_EXAM_ITEMS}), t AS (SELECT exam, sum(worth)::BIGINT AS max_score FROM i GROUP BY 1),
    a AS (SELECT * FROM ({_EXAM_ANSWERS}) WHERE rn = 1),
    x AS (SELECT a.exam, student, q, given, arg_min(i.id, i.pos) AS item, coalesce(arg_min(worth, i.pos), 1) AS worth FROM a LEFT JOIN i ON i.exam = a.exam AND NOT starts_with(i.id, 'P') AND (contains(i.id, q) OR contains(q, i.id)) GROUP BY 1, 2, 3, 4),
    r AS (SELECT x.*, coalesce(k.answer = given, FALSE) AS correct FROM x LEFT JOIN i AS k ON k.exam = x.exam AND k.id = coalesce(x.item, x.q)),
    c AS (SELECT exam, student, sum(CASE WHEN correct THEN worth ELSE 0 END)::BIGINT AS closed_score, count_if(correct AND contains(q, 'SM'))::BIGINT AS sm_right, count_if(correct AND contains(q, 'VF'))::BIGINT AS vf_right FROM r GROUP BY 1, 2),
    dv AS (SELECT l_orderkey % 5 AS exam, l_orderkey AS student, sum(n)::BIGINT AS development_score FROM (SELECT l_orderkey, l_linenumber, CASE WHEN min(l_quantity) % 2 = 0 THEN floor(min(l_quantity))::BIGINT % 3 ELSE 0 END AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2),
    s AS (SELECT c.*, development_score, closed_score + development_score AS score, max_score FROM c JOIN dv USING (exam, student) JOIN t USING (exam))
    SELECT exam, student, closed_score, development_score, sm_right, vf_right, score || '/' || max_score AS result, {_grade_sql('score::DOUBLE', 'max_score::DOUBLE')} AS grade, ceil(max_score * 0.6::DOUBLE)::BIGINT AS pass_points, max_score FROM s""",
)
def evaluate_route(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    points = F.concat((F.floor("q") % 3).cast("string"), F.when(F.col("q") % 2 == 0, "/3").otherwise(" de 3"))
    details = li.select((F.col("l_orderkey") % 5).alias("exam"), F.col("l_orderkey").alias("student"), F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("item"), points.alias("points"))
    return evaluate.evaluated(_exams(spark, d), _exam_answers(spark, d), details)


@query("evaluate_replies", ORACLES["evaluate_route"])
def evaluate_replies(spark, d):
    """As evaluate_route; the development points come from a reply for each student, JSON within other text."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    points = F.concat((F.floor("q") % 3).cast("string"), F.when(F.col("q") % 2 == 0, "/3").otherwise(" de 3"))
    entry = F.concat(F.lit('"P'), F.col("l_linenumber").cast("string"), F.lit('":{"puntaje":"'), points, F.lit('"}'))
    r = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(entry), ",").alias("items"))
    raw = F.concat(F.lit('Reply: {"puntaje":"1/2","retroalimentacion":{"detalle_puntaje_desarrollo":{'), F.col("items"), F.lit("}}} end"))
    replies = validated.parsed_replies(r.select((F.col("l_orderkey") % 5).alias("exam"), F.col("l_orderkey").alias("student"), raw.alias("raw")), F.col("raw"))
    return evaluate.evaluated(_exams(spark, d), _exam_answers(spark, d), evaluate.reply_details(replies))


@query("item_list", f"SELECT exam, coalesce(string_agg(id || ' (Máx: ' || worth || ' puntos)', ', ' ORDER BY pos) FILTER (starts_with(id, 'P')), '') AS items FROM ({_EXAM_ITEMS}) GROUP BY 1")
def item_list(spark, d):
    return evaluate.item_list(parse.score_sheet(_exams(spark, d), "sheet"), ["exam"])


@query(
    "report_rows",
    """SELECT conv_id AS student, turn::INT AS pos, role AS section, text AS detail FROM conversations
    UNION ALL SELECT conv_id, NULL, 'Pregunta Desarrollo: P ' || turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'Puntaje: ' || turn || '/9' || chr(10) || 'Respuesta Estudiante: "' || role || '"' || chr(10) || 'Justificación: x' END FROM conversations""",
)
def report_rows(spark, d):
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("P_"), F.col("turn").cast("string"))
    graded = F.concat(F.lit('{"puntaje": "'), F.col("turn").cast("string"), F.lit('/9", "justificacion": "x", "cita_estudiante": "'), F.col("role"), F.lit('"}'))
    details = c.select(F.col("conv_id").alias("student"), F.create_map(name, F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(graded)).alias("detail"))
    return evaluate.report_rows(c.select(F.col("conv_id").alias("student"), F.col("turn").alias("pos"), F.col("role").alias("section"), F.col("text").alias("detail")), details)


@query(
    "objective_counts",
    """WITH g AS (SELECT l_orderkey, list(upper(l_returnflag) ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS k, list(l_linestatus ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS v FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_filter(range(1, len(k) + 1), lambda i: k[i] = v[i] OR (k[i] = 'N' AND v[i] = 'O')))::INT AS correct FROM g""",
)
def objective_counts(spark, d):
    """The key is the flag; an answer is the state in lower case with blanks, O standing for N, in the order of lines."""
    said = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), " n ").otherwise(F.lower("l_linestatus"))
    at = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", said.alias("said"))))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(at.alias("a"))
    return g.select("l_orderkey", evaluate.objective_counts(F.transform("a", lambda x: x["l_returnflag"]), F.transform("a", lambda x: x["said"])).alias("correct"))


@query(
    "rescored",
    """SELECT p_partkey, 'SM' || p_partkey % 40 AS question, coalesce(n_regionkey + 1, 1)::INT AS item_max, CASE WHEN p_size % 2 = 0 THEN coalesce(n_regionkey + 1, 1) ELSE 0 END::INT AS points FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 40""",
)
def rescored(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.lit(1).alias("exam"), F.concat(F.lit("SM"), (F.col("p_partkey") % 40).cast("string")).alias("question"), (F.col("p_size") % 2).alias("given"), F.lit(0).alias("right"))
    i = table(spark, d, "nation").select(F.lit(1).alias("exam"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("SM"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_regionkey") + 1).alias("max_score"))
    return evaluate.rescored(a, i, ["exam"]).select("p_partkey", "question", "item_max", "points")


@query(
    "payment_checks",
    """SELECT o_orderkey, o_totalprice > 0 AS positive, floor(o_totalprice + 0.5::DOUBLE) <= 5000 AS payable, CASE o_custkey % 3 WHEN 0 THEN o_orderkey % 2 = 0 WHEN 1 THEN o_orderkey % 2 = 1 ELSE FALSE END AS price_fits,
    o_orderstatus IN ('F', 'O') AS paid, o_orderstatus = 'F' AS exactly_paid, o_custkey % 3 <> 2 AND o_orderstatus <> 'P' AS complete, CASE o_custkey % 3 WHEN 0 THEN 640 WHEN 1 THEN 1280 END AS credits,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1200 END::INT AS credits_of_price FROM orders""",
)
def payment_checks(spark, d):
    o = table(spark, d, "orders")
    plan = F.when(F.col("o_custkey") % 3 == 0, "intermediate").when(F.col("o_custkey") % 3 == 1, "pro").otherwise("")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "Completed")
    price = F.when(F.col("o_orderkey") % 2 == 0, 29900).otherwise(49900)
    return o.select(
        "o_orderkey", checks.positive_amount(F.col("o_totalprice")).alias("positive"), checks.payable(F.col("o_totalprice")).alias("payable"),
        checks.price_fits(price, readers.looked_up(plan, readers.PLAN_PRICE)).alias("price_fits"), checks.paid(status).alias("paid"), checks.exactly_paid(status).alias("exactly_paid"),
        checks.present(plan, status).alias("complete"), readers.looked_up(plan, readers.PLAN_CREDITS).alias("credits"),
        readers.looked_up(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(49990), readers.PRICE_CREDITS).alias("credits_of_price"),
    )


@query(
    "pending_groups",
    """WITH g AS (SELECT o_custkey, list(o_orderkey) FILTER (o_orderstatus <> 'P') AS files, o_custkey % 3 = 0 AS done, o_custkey % 5 = 0 AS busy FROM orders GROUP BY 1)
    SELECT o_custkey, coalesce(len(files), 0) > 0 AND NOT done AND NOT busy AS pending, done AS evaluated FROM g""",
)
def pending_groups(spark, d):
    k = F.col("o_custkey")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).alias("files"))
    return g.select("o_custkey", checks.pending(F.col("files"), k % 3 == 0, k % 5 == 0).alias("pending"), (k % 3 == 0).alias("evaluated"))


@query(
    "class_state",
    """SELECT o_orderpriority, bool_or(o_orderstatus = 'P') AS any_running, bool_and(o_totalprice > 1000) AS all_ready, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))::BIGINT AS chosen FROM orders GROUP BY 1""",
)
def class_state(spark, d):
    """Whether any and whether all groups of a class are in a state; and how many are among the chosen ids."""
    ids = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders")
    chosen = o.join(ids, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("chosen"))
    s = o.groupBy("o_orderpriority").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_running"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_ready"))
    return s.join(chosen, "o_orderpriority", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))


@query(
    "date_texts",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%d/%m/%Y') AS day, strftime(ts + INTERVAL 10 MINUTE, '%d/%m/%Y %H:%M') AS expires, strftime(ts + to_days((event_id % 60)::INT), '%d/%m/%Y') AS valid_until FROM events""",
)
def date_texts(spark, d):
    ts = F.col("ts")
    e = table(spark, d, "events")
    return e.select("event_id", dates.iso_utc(ts).alias("iso"), dates.day_month_year(ts).alias("day"), F.date_format(dates.code_expiry(ts), "dd/MM/yyyy HH:mm").alias("expires"), dates.day_month_year(dates.days_later(ts, (F.col("event_id") % 60).cast("int"))).alias("valid_until"))


@query("upper_key", "SELECT p_brand, pos, id, upper(value) AS answer FROM (SELECT p_brand, p_partkey AS pos, 'Q' || p_partkey % 7 AS id, p_type AS value FROM part)")
def upper_key(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("key_of"), F.concat(F.lit("Q"), (F.col("p_partkey") % 7).cast("string"), F.lit(": "), F.lower("p_type"), F.lit(" ; ")).alias("pair"))
    return parse.answer_key_upper(p, "pair").select("p_brand", F.col("key_of").alias("pos"), "id", "answer")


@query(
    "short_texts",
    """SELECT doc_id, coalesce(text, '')[1:500] AS start, length(coalesce(text, '')[1:500]) AS n, floor(100.0::DOUBLE * (doc_id % 997) / 997 * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS percent,
    CASE doc_id % 4 WHEN 0 THEN 'https://h/v1' WHEN 1 THEN 'https://h.org/v1' WHEN 2 THEN 'https://api.mistral.ai/v1' ELSE 'http://h.net/v1' END AS url FROM documents""",
)
def short_texts(spark, d):
    k = F.col("doc_id")
    url = F.when(k % 4 == 0, "[x](https://h/v1)").when(k % 4 == 1, "'h.org/' ").when(k % 4 == 2, "not a url").otherwise("http://h.net")
    start = text.shortened(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", start.alias("start"), F.length(start).cast("long").alias("n"), numeric.confidence_percent((k % 997) / F.lit(997.0)).alias("percent"), text.repaired_url(url).alias("url"))


@query(
    "plans_by_price",
    "SELECT id, credits, row_number() OVER (ORDER BY coalesce(price, 0), id)::BIGINT AS place FROM (SELECT p_partkey AS id, p_size AS credits, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS price FROM part)",
)
def plans_by_price(spark, d):
    """Parts as plans, numbered by rising price; every tenth has none, which goes as 0."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("credits"), F.when(k % 10 != 0, F.col("p_retailprice")).alias("price"))
    return batching.running(p.withColumn("price", readers.plan_price(F.col("price"))), "price", ["id"], {"place": F.lit(1)}).select("id", "credits", "place")


@query(
    "required_fields",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN n_chars % 2 <> 0 WHEN 3 THEN FALSE ELSE length(coalesce(text, '')) > 0 END AS complete FROM documents""",
)
def required_fields(spark, d):
    """The text "0" counts as there; an empty text, a missing one and the number 0 don't."""
    k = F.col("doc_id") % 5
    rubric = F.when(k == 0, "0").when(k == 1, "").when(k == 3, F.lit(None).cast("string")).when(k == 4, F.col("text")).otherwise("r")
    total = F.when(k == 2, F.col("n_chars") % 2).otherwise(F.lit(1).cast("long"))
    return table(spark, d, "documents").select("doc_id", checks.present(rubric, total).alias("complete"))


@query("balance_replies", "SELECT event_id, event_id % 4 IN (0, 3) AS found, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS remaining FROM events")
def balance_replies(spark, d):
    """What a balance service replies: a number, null, no row, and a text that is no number."""
    r, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    raw = F.when(r == 0, F.concat(F.lit('[{"remaining":'), k, F.lit("}]"))).when(r == 1, '[{"remaining":null}]').when(r == 2, "[]").otherwise('[{"remaining":"many"}]')
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", json_repair.path_exists(F.col("raw"), "$[0].remaining").alias("found"), json_repair.path_number(F.col("raw"), "$[0].remaining").alias("remaining"))


@query(
    "reply_reasons",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no puntaje' WHEN 2 THEN 'no retroalimentacion' ELSE 'no JSON object|no puntaje|no retroalimentacion' END AS reasons,
    CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::BIGINT END AS points, CASE WHEN event_id % 4 = 0 THEN 2 END AS items FROM events""",
)
def reply_reasons(spark, d):
    """Replies that pass or don't, with reasons, and the points of the development items that those who pass name."""
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('Here: {"puntaje":"1/2","nota":3,"retroalimentacion":{"detalle_puntaje_desarrollo":{"P1":{"puntaje":"'), k, F.lit('/50","cita_estudiante":"c"},"P2":{"puntaje":"many"}}}} bye')))
        .when(F.col("event_id") % 4 == 1, '{"puntaje":"","retroalimentacion":{}}')
        .when(F.col("event_id") % 4 == 2, '```json\n{"puntaje":"1/2"}\n```')
        .otherwise("no reply")
    )
    e = validated.parsed_replies(table(spark, d, "events").select("event_id", raw.alias("raw")), F.col("raw"))
    details = json_repair.development_details(F.col("reply"))
    good = F.size("reasons") == 0
    return e.select("event_id", F.array_join("reasons", "|").alias("reasons"), F.when(good, scoring.development_points(details)).alias("points"), F.when(good, F.size(details)).alias("items"))


_SECRET = "tiza"
_PADS = ["".join(f"\\x{b:02X}" for b in pad) for pad in text.key_pads(_SECRET)]
_PARAMS = "'amount=' || o_custkey || '&Order=' || o_orderkey || '&status=' || replace(o_orderpriority, ' ', '%20') || '&Status=' || o_orderstatus"


@query("signed_orders", f"SELECT o_orderkey, q AS query, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(q)))) AS signature FROM (SELECT o_orderkey, {_PARAMS} AS q FROM orders)")
def signed_orders(spark, d):
    """Parameters in the order of a locale, in which case counts after letters, and their signature."""
    pairs = {"status": "o_orderpriority", "Status": "o_orderstatus", "Order": "o_orderkey", "amount": "o_custkey"}
    params = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c).cast("string"))])
    q = table(spark, d, "orders").select("o_orderkey", text.query_string(params).alias("query"))
    return q.select("o_orderkey", "query", text.signed(F.col("query"), _SECRET).alias("signature"))


@query("json_entries", "SELECT event_id, 'a' AS key, json_extract_string(props, '$.k') AS value, '{\"a\":\"' || json_extract_string(props, '$.k') || '\",\"b\":\"' || event_type || '\"}' AS json FROM events UNION ALL SELECT event_id, 'b', event_type, '{\"a\":\"' || json_extract_string(props, '$.k') || '\",\"b\":\"' || event_type || '\"}' FROM events")
def json_entries(spark, d):
    m = F.create_map(F.lit("a"), F.get_json_object("props", "$.k"), F.lit("b"), F.col("event_type"))
    e = table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", json_repair.json_text(F.col("m")).alias("json"), F.explode(json_repair.entries(F.col("m"))).alias("e")).select("event_id", "e.key", "e.value", "json")


@query("first_wins", f"SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ANSWER_SQL}) AS rn FROM lineitem) WHERE rn = 1")
def first_wins_query(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *ANSWER_ORDER)
    return first_wins(li, ["l_orderkey", "l_linenumber"], ANSWER_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "form_bodies",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_orderpriority END AS priority, CASE o_orderkey % 3 WHEN 0 THEN '' END AS empty, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey::VARCHAR END AS customer FROM orders""",
)
def form_bodies(spark, d):
    """Request bodies: a form with a repeated key and an empty value, a JSON object, and one of no known type."""
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    priority = F.replace(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("+")), F.lit("-"), F.lit("%2D"))
    form = F.concat(F.lit("priority="), priority, F.lit("&empty=&customer="), c, F.lit("&customer=x&"))
    json = F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('","customer":"'), c, F.lit('"}'))
    raw = F.when(k == 0, form).when(k == 1, json).otherwise("neither")
    kind = F.when(k == 0, "application/x-www-form-urlencoded;charset=UTF-8").otherwise("application/json")
    o = table(spark, d, "orders").select("o_orderkey", readers.body(kind, raw).alias("b"))
    at = lambda name: F.try_element_at("b", F.lit(name))
    return o.select("o_orderkey", at("priority").alias("priority"), at("empty").alias("empty"), at("customer").alias("customer"))


@query(
    "data_urls",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS mime, sha256(encode(coalesce(text, ''))) AS digest, doc_id % 3 <> 2 AS accepted FROM documents""",
)
def data_urls(spark, d):
    """Texts as data URLs, with a type, with a type and a character set, and bare; of which the accepted types."""
    k, body = F.col("doc_id") % 3, F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    url = F.concat(F.when(k == 0, "data:text/plain;charset=utf-8;base64,").when(k == 1, "data:image/png;base64,").otherwise(""), F.replace(body, F.lit("\r\n")))
    f = table(spark, d, "documents").select("doc_id", readers.data_url(url).alias("f")).select("doc_id", "f.mime", F.sha2("f.content", 256).alias("digest"))
    kept = readers.accepted(f).select("doc_id", F.lit(True).alias("accepted"))
    return f.join(kept, "doc_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


@query(
    "number_texts",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::DOUBLE ELSE 0.0 END AS whole, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN o_custkey + 0.5 ELSE 0.0 END AS leading,
    CASE WHEN o_orderkey % 4 < 2 THEN o_custkey::INT END AS integer, CASE o_orderkey % 4 WHEN 0 THEN least(7.0::DOUBLE, greatest(1.0::DOUBLE, o_custkey::DOUBLE)) ELSE 1.0 END AS clamped,
    CASE WHEN o_totalprice > 1000 THEN o_totalprice ELSE floor(o_totalprice + 0.5::DOUBLE) END AS amount FROM orders""",
)
def number_texts(spark, d):
    """Numbers with blanks, before a unit, after one, and missing."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    t = F.when(k == 0, F.concat(F.lit(" "), c, F.lit("\t"))).when(k == 1, F.concat(c, F.lit(".5 pts"))).when(k == 2, F.concat(F.lit("pts "), c))
    return table(spark, d, "orders").select("o_orderkey", numeric.parse_number(t).alias("whole"), numeric.parse_leading_number(t).alias("leading"), numeric.parse_int(t).alias("integer"), numeric.clamp_grade(t).alias("clamped"), numeric.amount(F.col("o_totalprice")).alias("amount"))


@query(
    "text_variants",
    """SELECT doc_id, 'Doc_' || doc_id || '_' || coalesce(lang, '') || '_pdf' AS slug, 'Doc ' || doc_id AS label, 'a<br>' || doc_id AS breaks, 'see' || chr(10) || 'end' AS unmarked, CASE WHEN doc_id % 2 = 0 THEN 'pro-' || doc_id END AS plan,
    'https://h/' || doc_id AS url, 'secret…' || right('000' || doc_id, 4) AS masked, (doc_id % 7)::VARCHAR AS obtained, '7' AS maximum, doc_id % 4 = 0 AS strict, doc_id % 4 IN (0, 1) AS loose, doc_id % 4 <> 3 AS basic FROM documents""",
)
def text_variants(spark, d):
    k = F.col("doc_id").cast("string")
    mail = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a"), k, F.lit("@x.org"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("mail a"), k, F.lit("@x.org now"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("a@"), k, F.lit("0"))).otherwise("none")
    score = text.score_parts(F.concat((F.col("doc_id") % 7).cast("string"), F.lit("/7")))
    return table(spark, d, "documents").select(
        "doc_id", text.slug(F.concat(F.lit("Doc "), k, F.lit("-"), F.coalesce("lang", F.lit("")), F.lit(".pdf"))).alias("slug"), text.label(F.concat(F.lit("Doc_"), k)).alias("label"),
        text.line_breaks(F.concat(F.lit("a\n"), k)).alias("breaks"), text.strip_marks(F.concat(F.lit("see\n[OMR_MARK] x="), k, F.lit("\nend"))).alias("unmarked"),
        text.plan_of_subject(F.concat(F.when(F.col("doc_id") % 2 == 0, "Plan:PRO-").otherwise("Other:PRO-"), k), "plan:").alias("plan"), text.without_slashes(F.concat(F.lit("https://h/"), k, F.lit("//"))).alias("url"),
        text.masked_secret(F.concat(F.lit("secret-key-000"), k)).alias("masked"), score["obtained"].alias("obtained"), score["maximum"].alias("maximum"),
        *[text.valid_email(mail, rule).alias(rule) for rule in ("strict", "loose", "basic")],
    )


@query(
    "line_keys",
    """SELECT conv_id, list_transform(string_split('A,B' || max(turn), ','), lambda x: upper(x)) AS sm, CASE WHEN count(*) > 2 THEN ['V', 'F'] ELSE [] END AS vf FROM conversations GROUP BY 1""",
)
def line_keys(spark, d):
    """Keys by lines, of which the last of each kind counts."""
    n = F.col("last").cast("string")
    key = F.concat(F.lit("SM:x,y\n note\nSM: a , b"), n, F.when(F.col("turns") > 2, "\n VF: v,f").otherwise(""))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("turns")).select("conv_id", key.alias("key"))
    return parse.line_key(c, "key").select("conv_id", "sm", "vf")


@query(
    "ledger_gates",
    """WITH b AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 10 ELSE -4 END)::BIGINT AS balance FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1),
    u AS (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1),
    w AS (SELECT user_id, count(*)::BIGINT AS fresh FROM events AS e WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase') GROUP BY 1)
    SELECT user_id, coalesce(balance, 0) <= 0 AS blocked, coalesce(fresh, 0)::BIGINT AS fresh, ceil(n / 45.0)::BIGINT AS chunks, CASE WHEN user_id % 3 = 0 THEN TRUE ELSE user_id % 100 < 98 END AS confirm FROM u LEFT JOIN b USING (user_id) LEFT JOIN w USING (user_id)""",
)
def ledger_gates(spark, d):
    """Users without credit, their events that aren't among the paid ones, the chunks of their events, and captures that need confirming."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    balance = ledger.balances(_entries(spark, d, -4).withColumnRenamed("user_id", "owner")).withColumnRenamed("owner", "user_id")
    fresh = ledger.new_orders(e.select("event_id", "user_id"), e.where("event_type = 'purchase'"), "event_id").groupBy("user_id").agg(F.count("*").alias("fresh"))
    u = e.groupBy("user_id").agg(F.count("*").alias("n")).join(balance, "user_id", "left").join(fresh, "user_id", "left")
    sure = F.when(F.col("user_id") % 3 == 0, 0.5).otherwise((F.col("user_id") % 100) / F.lit(100.0))
    return u.select("user_id", ledger.blocked(F.col("balance")).alias("blocked"), F.coalesce("fresh", F.lit(0)).alias("fresh"), batching.chunks_needed(F.col("n")).alias("chunks"), omr.to_confirm(sure).alias("confirm"))


@query(
    "answer_lists",
    """WITH g AS (SELECT conv_id, list(role ORDER BY turn, text) AS r, list(turn ORDER BY turn, text) AS t FROM conversations GROUP BY 1)
    SELECT conv_id, list_transform(r[:5], lambda x: x) AS first_ones, greatest(len(r) - 5, 0)::INT AS others, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(r) AS x, unnest(range(len(r))) AS i) GROUP BY x)) AS distinct_roles,
    CASE WHEN conv_id % 2 = 0 THEN [conv_id::VARCHAR] ELSE r END AS answers, CASE WHEN conv_id % 2 = 0 THEN 'submitted' ELSE r[1] END AS source, CASE WHEN conv_id % 3 = 0 THEN ['a', conv_id::VARCHAR] ELSE [] END AS names,
    '{"a":"' || conv_id || '"}' AS braces FROM g""",
)
def answer_lists(spark, d):
    """First five and others, distinct ones in order, submitted answers over extracted ones, lists in JSON, text between braces."""
    k = F.col("conv_id").cast("string")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: x["role"])
    g = table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("r"))
    first, rest = sinks.first_and_rest(F.col("r"))
    own = F.when(F.col("conv_id") % 2 == 0, F.array(k)).otherwise(F.array().cast("array<string>"))
    listed = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('["a","'), k, F.lit('"]'))).otherwise("no list")
    alias = F.when(F.col("conv_id") % 2 == 0, "submitted").otherwise("")
    return g.select(
        "conv_id", first.alias("first_ones"), F.size(rest).alias("others"), first_of_each(F.col("r"), lambda x: x).alias("distinct_roles"), scoring.overridden(own, F.col("r")).alias("answers"),
        json_repair.first_of(alias, F.lit(None).cast("string"), F.get("r", F.lit(0))).alias("source"), json_repair.string_list(listed).alias("names"), json_repair.braces(F.concat(F.lit("so: {"), F.lit('"a":"'), k, F.lit('"} ok'))).alias("braces"),
    )


@query("mean_confidence", "SELECT round(coalesce(avg(c), 0.0), 9) AS confidence FROM (SELECT 1 - max(l_discount) AS c FROM lineitem GROUP BY l_orderkey, l_linestatus, l_linenumber, l_quantity)")
def mean_confidence(spark, d):
    """The mean over all marks, to nine places, as the order of a sum is not fixed."""
    m = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber", "l_quantity").agg((1 - F.max("l_discount")).alias("confidence"))
    return omr.mean_confidence(m).select(F.round("confidence", 9).alias("confidence"))


@query(
    "protocol_lines",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, event_type FROM events), t AS (SELECT count(*) AS n FROM events)
    SELECT -1 AS place, '{"type":"meta","totalItems":' || n || ',"totalBatches":' || ceil(n / 45.0)::BIGINT || ',"batchSize":45,"maxConcurrent":3}' AS value FROM t
    UNION ALL SELECT n, '{"type":"result","batchIndex":' || n // 45 || ',"groupId":"' || event_id || '","success":' || CASE WHEN event_type = 'error' THEN 'false,"error":"bad"}' ELSE 'true,"data":"' || event_type || '"}' END FROM r
    UNION ALL SELECT 4611686018427387904, '{"type":"done"}'""",
)
def protocol_lines(spark, d):
    """All events as the results of one batch."""
    bad = F.col("event_type") == "error"
    e = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("groupId"), (~bad).alias("success"), F.when(~bad, F.col("event_type")).alias("data"), F.when(bad, "bad").alias("error"))
    return sinks.protocol(e, "event_id")


def _ran(stream) -> None:
    """Waits for a stream that ends with its input."""
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(
    "stream_split",
    """SELECT CASE WHEN event_id % 50 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN event_id % 50 <> 0 THEN event_type <> 'error' END AS success, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""",
)
def stream_split(spark, d):
    """Events as lines of growing files, some of them malformed; a stream that splits them; its counts."""
    folder = new_folder(spark)
    line = F.to_json(F.struct(F.lit("result").alias("type"), F.col("user_id").cast("string").alias("groupId"), (F.col("event_type") != "error").alias("success")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{bad "), line)).otherwise(line)).write.text(f"{folder}/lines")
    lines = readers.parsed_lines(growing_lines(spark, f"{folder}/lines"))
    _ran(validated.split_stream(validated.with_reasons(lines, {"malformed line": F.col("malformed").isNull()}), f"{folder}/split", f"{folder}/offsets"))
    return spark.read.parquet(f"{folder}/split").groupBy("outcome", "success").agg(F.count("*").alias("n"))


@query(
    "stream_outcomes",
    """SELECT o_custkey::VARCHAR AS stream, o_orderkey::VARCHAR AS "groupId", o_orderkey % 4 <> 0 AND o_orderstatus = 'F' AS success,
    CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderstatus <> 'F' THEN 'bad page' END WHEN o_custkey % 3 = 0 THEN 'HTTP 500' ELSE 'No result in the stream' END AS error,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'result' WHEN o_custkey % 3 = 0 THEN 'failed' ELSE 'done' END AS closed_by FROM orders""",
)
def stream_outcomes(spark, d):
    """A customer's orders are the items of a stream; every fourth has no result; streams end or fail."""
    folder, o = new_folder(spark), table(spark, d, "orders")
    good, none, text_none = F.col("o_orderstatus") == "F", F.lit(None).cast("boolean"), F.lit(None).cast("string")
    stream, item = F.col("o_custkey").cast("string").alias("stream"), F.col("o_orderkey").cast("string")
    results = o.where("o_orderkey % 4 <> 0").select(stream, F.col("o_orderkey").cast("long").alias("order"), F.lit("result").alias("type"), item.alias("groupId"), good.alias("success"), text_none.alias("data"), F.when(~good, "bad page").alias("error"))
    lost = F.col("o_custkey") % 3 == 0
    ends = o.select("o_custkey").distinct().select(stream, F.lit(2**62).alias("order"), F.when(lost, "failed").otherwise("done").alias("type"), text_none.alias("groupId"), none.alias("success"), text_none.alias("data"), F.when(lost, "HTTP 500").alias("error"))
    starts = completion.started(o.select(item.alias("item"), stream), "stream", "item")
    events = starts.unionByName(results).unionByName(ends)
    events.write.parquet(f"{folder}/events")
    _ran(completion.complete_batches(spark.readStream.schema(events.schema).parquet(f"{folder}/events"), f"{folder}/out", f"{folder}/offsets"))
    return completion.outcomes(spark, f"{folder}/out").drop("data")


@query("stream_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def stream_latest(spark, d):
    """The latest event of each user by two micro-batches into a state of buckets."""
    folder, e = new_folder(spark), table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/events")
        _ran(state.keep_latest(stream, f"{folder}/state", f"{folder}/offsets", ["user_id"], ["ts", "event_id"], 16))
    return state.latest_state(spark, f"{folder}/state", e.schema).drop("event_id")
