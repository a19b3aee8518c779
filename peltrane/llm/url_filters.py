"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes, then confirmed.

A url has a host (after the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased) and a path (up to `?`, `#` or
the end). A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path. Each url is
expanded only into the (number of labels, path length) pairs that occur among the rules, so its expansions are bounded by
the rules' shapes and not by the url's length. The equi-join is on the first 8 hex digits of SHA-256; the full digests
are compared next; the longest host wins, then the longest path, then block over allow.

Only the id and url columns are read; other columns, whatever their names, are ignored. A null url, or one without `://`,
has an empty host and path and gets the default verdict. Repeated rows and null ids each keep a row of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, with_row_id

#: (verdict, host, path): the rules of the contract, fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SHORT = 8  # hex digits of the hash prefix
BROADCAST_RULES = 20_000  # rules up to this count are broadcast; beyond it Spark plans the join by size


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules, short: int = SHORT) -> DataFrame:
    """rank (higher wins), rule, verdict, digest, short."""
    ordered = sorted(set(rules), key=lambda r: (r[1].count(".") + 1, len(r[1]), len(r[2]), r[0], r[1], r[2]))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({k}L, {quote(h + p)}, {quote(v)})" for k, (v, h, p) in enumerate(ordered))
    base = spark.sql(f"SELECT * FROM VALUES {rows or '(0L, CAST(NULL AS STRING), CAST(NULL AS STRING))'} AS t(rank, rule, rule_verdict)")
    return base.where("rule IS NOT NULL").withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, short))


def url_verdicts(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", short: int = SHORT) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict."""
    spark, rules = pages.sparkSession, tuple(rules)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = with_row_id(urls)
    labels = F.size(F.split("host", r"\."))
    expressions = F.filter(
        F.array(*[F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in shapes])
        if shapes
        else F.array().cast("array<string>"),
        lambda e: e.isNotNull(),
    )
    spread = urls.withColumn("digest", F.explode_outer(F.transform(expressions, lambda e: F.sha2(e, 256)))).withColumn("short", F.substring("digest", 1, short))
    known = rule_table(spark, rules, short)
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    index = known.select(F.col("short").alias("_short"), F.col("digest").alias("_digest"), F.col("rank").alias("_rank"))
    hits = spread.join(small(index), F.col("short") == F.col("_short"), "left")  # short prefixes meet; full digests confirm
    best = hits.groupBy("_rid", "page_id", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("_digest"), F.col("_rank"))).alias("rank"))
    said = best.join(small(known.select("rank", "rule", "rule_verdict")), "rank", "left")
    return said.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


ORACLE = f"""
WITH r(verdict, h, p) AS (VALUES {", ".join(str(x) for x in RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS u FROM pages),
v AS (SELECT rid, page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM u),
w AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM v)
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict
FROM w LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h) DESC NULLS LAST, length(p) DESC) = 1
"""
