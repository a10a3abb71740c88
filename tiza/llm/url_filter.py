"""URL filter with empirical-Bayes host reputation.

Labelled page outcomes (1: bad, 0: good) are counted by host, registered domain and suffix. Each level's rate is a beta
posterior whose prior mean is the posterior mean of the level above (suffix: the overall rate) and whose strength comes
from the spread of that level's rates. A host is blocked if the lower bound of its posterior bad rate passes a limit.
Hosts without labels use their domain's posterior, then the suffix's, then the overall rate. Fixed rules come first.

A registered domain is a public suffix and one label more; `suffixes` lists the suffixes of two or more labels, and any last
label is one. An IP address is its own domain and suffix. A page_id that occurs more than once gives each of its rows' hosts
its outcomes, and an id with several labels several outcomes.

Null or malformed urls have empty host and path and use the overall rate; very long ones are read whole, like others. Repeated rows stay repeated. Without labels all
that no rule blocks is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import LOWER, UPPER, beta_strength, join_by_key, stored, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null. rules is a short configured list: it becomes one CASE."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Public suffixes of more than one label under which anyone can register, and shared hosting domains: a default, to be replaced by a full list.
SUFFIXES = (
    "ac.jp", "ac.uk", "blogspot.com", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.pl",
    "com.sg", "com.tr", "com.tw", "edu.au", "github.io", "go.jp", "gov.au", "gov.br", "gov.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.nz", "net.uk", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
ADDRESS = r"^[0-9.]+$|^\["


def _levels(host: Column, suffixes: tuple = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix without port."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    last = lambda k: F.substring_index(bare, ".", -k)
    domain, suffix = last(2), last(1)
    for k in sorted({x.count(".") + 1 for x in suffixes} - {1}):  # longer suffixes go last and so come first
        fits = last(k).isin(*[x for x in suffixes if x.count(".") + 1 == k])
        domain, suffix = F.when(fits, last(k + 1)).otherwise(domain), F.when(fits, last(k)).otherwise(suffix)
    address = bare.rlike(ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def host_reputation(outcomes: DataFrame, z: float = 1.64, suffixes: tuple = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors by host, domain, suffix and overall from outcomes(host, bad).

    The rows shrink to one per host in the first aggregation, which is written; all else works on those counts."""
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("f"))
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "f"))
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.sum("f").alias("f")))
    suffixes_ = stored(domains.groupBy("suffix").agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.sum("f").alias("f")))
    overall = suffixes_.agg(F.sum("n").alias("n"), F.sum("f").alias("f")).select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("f") + 1) / (F.col("n") + 2), F.lit(0.5)).alias("mean"))

    def strength(level: DataFrame) -> DataFrame:
        """One row: the pseudo-count that this level's rates suggest."""
        s = level.agg(F.sum("n").alias("N"), F.count("*").alias("G"), F.sum("f").alias("A"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("Q"))
        m = F.col("A") / F.col("N")
        k = beta_strength(F.col("N"), m, F.col("Q") / F.col("N") - m * m, F.col("G"))
        return s.select(F.coalesce(F.when(F.col("N") > 0, k), F.lit(1.0)).alias("k"))

    def posterior(level: DataFrame, prior: str, keys: list[str], mean_name: str) -> DataFrame:
        level = level.join(F.broadcast(strength(level.select("n", "f"))))  # an aggregate without keys: one row
        mean = (F.col("f") + F.col("k") * F.col(prior)) / (F.col("n") + F.col("k"))
        bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("k") + 1))
        return stored(level.select(*keys, "n", "f", mean.alias(mean_name), bound.alias(f"{mean_name}_bound")))

    # a suffix may hold most domains, and a domain most hosts: these joins serve such keys by broadcast
    s_post = posterior(suffixes_.join(F.broadcast(overall.select("mean"))), "mean", ["suffix", "members"], "s_mean")
    d_post = posterior(join_by_key(domains, s_post.select("suffix", "members", "s_mean"), "suffix", "members"), "s_mean", ["domain", "members"], "d_mean")
    h_post = posterior(join_by_key(hosts, d_post.select("domain", "members", "d_mean"), "domain", "members"), "d_mean", ["host"], "h_mean")
    return h_post, d_post, s_post, overall


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple = RULES, limit: float = 0.5, z: float = 1.64, id_col: str = "page_id", url_col: str = "url", suffixes: tuple = SUFFIXES
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) for each row of pages.

    labels(page_id, bad): outcomes; null ids or outcomes and ids without a page are left out. The verdicts' join serves hosts
    that hold much of the pages by broadcast and shuffles only the others."""
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    marked = labels.select(F.col("page_id").alias("label_id"), F.col("bad").cast("long").alias("bad")).where("label_id is not null and bad is not null")
    outcomes = p.where("host <> ''").join(marked, F.col("page_id") == F.col("label_id")).select("host", "bad")
    h_post, d_post, s_post, overall = host_reputation(outcomes, z, suffixes)
    # verdicts are worked out once for each distinct host and joined back
    domain, suffix = _levels(F.col("host"), suffixes)
    seen = stored(p.groupBy("host").agg(F.count("*").alias("pages")).select("host", "pages", domain.alias("domain"), suffix.alias("suffix")))

    def by(rows: DataFrame, post: DataFrame, key: str, bound: str) -> DataFrame:
        """rows with the bound of their domain or suffix; the key's number of hosts here says whether it is hot."""
        held = seen.groupBy(key).agg(F.count("*").alias("held"))
        return join_by_key(rows, held.join(post.select(key, bound), key), key, "held")

    # a host, domain or suffix without a label of its own takes the bound of the next level that has one
    m = F.col("o_mean")
    scored = seen.join(h_post.select("host", "h_mean_bound"), "host", "left")
    scored = by(by(scored, d_post, "domain", "d_mean_bound"), s_post, "suffix", "s_mean_bound")
    overall = overall.select(F.col("mean").alias("o_mean"), F.col("n").alias("o_n"))
    scored = scored.join(F.broadcast(overall)).select(
        "host", "pages", F.coalesce("h_mean_bound", "d_mean_bound", "s_mean_bound", m - z * F.sqrt(m * (1 - m) / (F.col("o_n") + 3))).alias("bad_bound")
    )
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    out = join_by_key(p, stored(scored), "host", "pages").withColumn("hit", rule)
    verdict = F.coalesce("hit.verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "bad_bound")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages, with the bound of the host's posterior bad rate to six places."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    )
    return filter_urls(table(spark, sf_dir, "pages"), labels).withColumn("bad_bound", F.round("bad_bound", 6))


def _oracle() -> str:
    case = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'"
        for v, r in sorted(RULES, key=lambda x: -len(x[1]))
    )
    strength = "SELECT coalesce(least(greatest(m * (1 - m) / greatest(q / n - m * m - m * (1 - m) * g / n, 1e-9) - 1, 1.0), 1e6), 1.0) AS k FROM (SELECT sum(n) AS n, count(*) AS g, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM {})"

    def post(prior: str, bound: str) -> str:
        mean = f"((f + k * {prior}) / (n + k))"
        return f"{mean} AS {bound}_mean, {mean} - 1.64 * sqrt({mean} * (1 - {mean}) / (n + k + 1)) AS {bound}_bound"

    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lv AS (SELECT host, CASE WHEN k = 0 THEN bare ELSE array_to_string(parts[-k:], '.') END AS suffix, CASE WHEN k = 0 THEN bare ELSE array_to_string(parts[-(k + 1):], '.') END AS domain
       FROM (SELECT *, string_split(bare, '.') AS parts, CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN 0 WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN {SUFFIXES} THEN 2 ELSE 1 END AS k
             FROM (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM (SELECT DISTINCT host FROM p)))),
oc AS (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM p JOIN labels ON doc_id = page_id WHERE host <> ''),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS f FROM oc JOIN lv USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(f) AS f FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(f) AS f FROM d GROUP BY ALL),
o AS (SELECT (coalesce(sum(f), 0) + 1) / (coalesce(sum(n), 0) + 2) AS o_mean, coalesce(sum(n), 0) AS o_n FROM s),
sk AS ({strength.format('s')}), dk AS ({strength.format('d')}), hk AS ({strength.format('h')}),
sp AS (SELECT suffix, {post('o_mean', 's')} FROM s, o, sk),
dp AS (SELECT domain, {post('s_mean', 'd')} FROM d JOIN sp USING (suffix), dk),
hp AS (SELECT host, {post('d_mean', 'h')} FROM h JOIN dp USING (domain), hk),
v AS (SELECT host, coalesce(h_bound, d_bound, s_bound, o_mean - 1.64 * sqrt(o_mean * (1 - o_mean) / (o_n + 3))) AS b
      FROM lv LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix), o),
r AS (SELECT page_id, host, path, CASE {case} END AS hit FROM p)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
       CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN b > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(b, 6) AS bad_bound
FROM r LEFT JOIN v USING (host)"""


ORACLE = _oracle()
