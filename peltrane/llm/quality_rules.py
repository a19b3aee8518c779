"""Quality rules on documents, and host-level rules made of them.

Per document: words are `[^\\x20\\x09-\\x0D]+`; word_chars, n_symbols, n_dup_lines and n_repeat_words as in the contract;
base_failed if n_words < 50 or 100 * n_repeat_words > 50 * n_words. Those are the rules `short` and `repeats`; three more
count for hosts alone: `symbols` (over one for ten words), `lines` (over three in ten lines repeat an earlier one) and
`word_length` (a mean below 3 or above 10).

Per host (the `source` column; null is a host of its own) and rule, the documents that fail it are counted. Each rule has a beta
prior fitted to all hosts' rates by their mean and variance: strength = mean * (1 - mean) / variance - 1, held in [4, 1000];
a host's rate is shrunk to (failures + mean * strength) / (n + strength). A host is rejected by a rule if its shrunk rate is in
the prior's upper tail, over `tail` standard deviations above the mean, and over half (`least_rate`): most of what it has is junk then. With the
host go all of its documents; host_rules names the rules that reject it.

All in Spark's own expressions. Row-local work is done once and written to the shared folder; the host sums are partial
aggregates, so a hot host costs one row for each task; the verdicts are joined back, by broadcast only if Spark's size
estimate of the host table allows it, else with skewed partitions split.

A null text has no words. Empty and very long texts are whole; repeated rows and null ids keep their rows; other columns
than those named are ignored unless asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, spread

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TAIL, LEAST_RATE = 3.0, 0.5
#: Rules that hosts are judged by, in terms of the measures (SQL of Spark and of other engines). Fixed values.
RULES = (
    ("short", f"n_words < {MIN_WORDS}"),
    ("repeats", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at two places or more: equal window hashes meet by a sort of (hash, place)."""

    def marked(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda s: F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()
        )
        covered = lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(F.array_sort(places(s)), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, marked))


def _lines(text: Column) -> Column:
    """Lines with a word, and those of them that are equal to an earlier one."""
    worded = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    return let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))


def measured(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            lines["again"].alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            lines["n"].alias("n_lines"),
        )

    return let(word_array(text), lambda w: let(_lines(text), lambda lines: of(w, lines)))


def host_verdicts(rows: DataFrame, *, tail: float = TAIL, least_rate: float = LEAST_RATE) -> DataFrame:
    """_host, n, and host_rules: the rules that reject the host, comma-joined. rows: one per document, _host and the measures."""
    count = lambda rule: F.sum(F.expr(f"CAST({rule} AS INT)")).cast("long")
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[count(f"({r})").alias(f"f_{k}") for k, r in RULES])
    moments = [f(F.col(f"f_{k}") / F.col("n")).alias(f"{name}_{k}") for k, _ in RULES for name, f in (("mean", F.avg), ("var", F.var_pop))]
    prior = hosts.agg(*moments).first()  # one row
    said = []
    for k, _ in RULES:
        mean, variance = prior[f"mean_{k}"] or 0.0, prior[f"var_{k}"] or 0.0
        strength = max(4.0, min(1000.0, mean * (1 - mean) / variance - 1)) if variance > 0 else 1000.0
        limit = max(least_rate, mean + tail * (mean * (1 - mean) / (strength + 1)) ** 0.5)
        rate = (F.col(f"f_{k}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        said.append(F.when(rate > limit, F.lit(k)))
    return hosts.select("_host", "n", F.concat_ws(",", *said).alias("host_rules"))


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep_columns: bool = False, **options) -> DataFrame:
    """doc_id, the measures, base_failed, kept, host_rules; with keep_columns, the input's rows as a struct `_doc`, and `_kept`."""
    if keep_columns:
        rows = spread(docs).select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_doc"), F.col(host_col).alias("_source"), measured(F.col(text_col)).alias("_m"))
    else:
        rows = spread(docs.select(*dict.fromkeys([id_col, host_col, text_col]))).select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("_source"), measured(F.col(text_col)).alias("_m"))
    rows = materialize(rows, "quality")
    hosts = host_verdicts(rows.select(F.col("_source").alias("_host"), "_m.*"), **options).select("_host", "host_rules")
    joined = rows.join(materialize(hosts, "hosts"), F.col("_source").eqNullSafe(F.col("_host")), "left")  # written, so its size is known
    n, repeated = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (F.col("host_rules") == "")
    if keep_columns:
        return joined.select("_doc", kept.alias("_kept"))
    return joined.select("doc_id", *[f"_m.{c}" for c in MEASURES], failed.alias("base_failed"), kept.alias("kept"), "host_rules")


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    return quality_verdicts(docs, keep_columns=True, **options).where("_kept").select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM d),
p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
q AS (SELECT rid, i, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, CASE WHEN z IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, x, y, z) END AS n FROM q),
f AS (SELECT rid, greatest(n, lag(n, 1, 0) OVER s, lag(n, 2, 0) OVER s) >= 2 AS hit FROM c WINDOW s AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, count(*) FILTER (WHERE hit) AS n_repeat_words FROM f GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN g USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {r}) AS f_{k}" for k, r in RULES)} FROM b GROUP BY source),
l AS (SELECT source, n, unnest([{", ".join(f"{{'rule': '{k}', 'place': {i}, 'f': f_{k}}}" for i, (k, _) in enumerate(RULES))}], recursive := true) FROM h),
pr AS (SELECT rule, avg(f / n) AS mean, var_pop(f / n) AS v FROM l GROUP BY rule),
ps AS (SELECT rule, mean, CASE WHEN v > 0 THEN greatest(4.0, least(1000.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS s FROM pr),
hr AS (SELECT source, coalesce(string_agg(rule, ',' ORDER BY place) FILTER (WHERE (f + mean * s) / (n + s) > greatest({LEAST_RATE}, mean + {TAIL} * sqrt(mean * (1 - mean) / (s + 1)))), '') AS host_rules FROM l JOIN ps USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rules = '' AS kept, host_rules
FROM b JOIN hr ON b.source IS NOT DISTINCT FROM hr.source
"""
