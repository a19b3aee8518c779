"""License scans: ordered signature rules, gated by keywords, with overlaps resolved by priority and containment.

The text is lower-cased (A-Z) and its words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` are joined by single blanks. A rule's pattern
is tried only if its keyword stands in that text, and no keyword is looked for unless one pass finds a word of one. Detections are intervals; in order of start, longer first, one that lies
within an earlier interval of a better tier, or of the same tier, is suppressed. What is left gives labels and the score:
1.0, 0.8 or 0.5 for the best tier left, 0.0 for none. The base phrases are found at all their places, overlaps included;
they are never suppressed.

One pass over the rows in Spark's own expressions: no join, shuffle or explode, so no skew. The rules are a literal of a
few hundred rows.

A null or empty text has no words and no labels. Texts are whole. Repeated rows and null ids keep their rows; columns other
than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, spread
from .license_rules import gate_pattern, gate_words
from .license_rules import rules as all_rules

#: The base phrases and labels of the contract, fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCORES = (1.0, 0.8, 0.5)


def normal(text: Column) -> Column:
    """The words between single blanks, with one blank before and after; one blank if there are none."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))
    return F.when(flat == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def _blanks(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _base(norm: Column, phrase: str) -> Column:
    """places, first, last of one phrase: a place is followed by its words, so places that share words all count."""
    probe, n = f" {phrase} ", len(phrase) + 2
    at = F.locate(probe, norm)
    back = F.locate(probe[::-1], F.reverse(norm))
    count = F.regexp_count(norm, F.lit(f"(?= {phrase} )")).cast("long")
    return F.when(
        at > 0,
        F.struct(
            count.alias("places"),
            _blanks(F.substring(norm, F.lit(1), at - 1)).alias("first"),
            _blanks(F.substring(norm, F.lit(1), F.length(norm) - back + 1 - n)).alias("last"),
        ),
    )


def _intervals(norm: Column, rule: Column) -> Column:
    """Where a rule's pattern matches: character intervals, from what it matches and what stands between."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))

    def placed(found: Column, gaps: Column) -> Column:
        ends = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("g")))
        return F.aggregate(
            ends,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,neg_end:int>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("start"), (-(a["at"] + F.length(x["g"]) + F.length(x["m"]))).alias("neg_end")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    spans = let(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda found: let(F.split(norm, pattern, F.lit(-1)), lambda gaps: placed(found, gaps)))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["neg_end"].alias("neg_end"), rule["tier"].alias("tier"), rule["label"].alias("label")))


def _resolved(found: Column) -> Column:
    """Labels and best tier left after suppression, by one pass that knows how far each tier's intervals reach."""
    zero = F.struct(*[F.lit(0).alias(f"reach{t}") for t in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(4).alias("best"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, d: Column) -> Column:
        end = -d["neg_end"]
        inside = F.lit(False)
        for t in (1, 2, 3):
            inside = inside | ((d["tier"] >= t) & (a[f"reach{t}"] >= end))
        return F.struct(
            *[F.when(d["tier"] == t, F.greatest(a[f"reach{t}"], end)).otherwise(a[f"reach{t}"]).alias(f"reach{t}") for t in (1, 2, 3)],
            F.when(inside | F.array_contains(a["labels"], d["label"]), a["labels"]).otherwise(F.concat(a["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, a["best"]).otherwise(F.least(a["best"], d["tier"])).alias("best"),
            (a["n"] + F.when(inside, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(F.array_sort(found), zero, step, lambda a: F.struct(a["labels"].alias("labels"), a["best"].alias("best"), a["n"].alias("n")))


def scanned(text: Column, rules=None) -> Column:
    """A struct of n_words, the base phrases' places, the rules' labels, best tier and number of detections left."""
    rules = all_rules() if rules is None else rules
    table = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(label).alias("label"), F.lit(f" {k} ").alias("keyword"), F.lit(p).alias("pattern")) for t, label, k, p in rules])
    gate = gate_pattern(gate_words(rules))

    def with_norm(norm: Column) -> Column:
        tried = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
        found = F.when(F.regexp_like(norm, F.lit(gate)), F.flatten(F.transform(tried, lambda r: _intervals(norm, r))))
        none = F.array().cast("array<struct<start:int,neg_end:int,tier:int,label:string>>")
        return F.struct(
            (F.when(norm == " ", F.lit(0)).otherwise(_blanks(norm) - 1)).cast("long").alias("n_words"),
            F.array(*[_base(norm, p) for p, _ in BASE]).alias("base"),
            let(F.coalesce(found, none), _resolved).alias("found"),
        )

    return let(normal(text), with_norm)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    s = rows.select("doc_id", scanned(F.col("text"), rules).alias("s"))
    base = F.filter(F.transform(F.col("s.base"), lambda b, i: F.when(b.isNotNull(), F.get(F.array(*[F.lit(x) for _, x in BASE]), i))), lambda x: x.isNotNull())
    places = F.filter(F.col("s.base"), lambda b: b.isNotNull())
    best = F.least(F.col("s.found.best"), F.when(F.size(base) > 0, F.lit(2)).otherwise(F.lit(4)))
    return s.select(
        "doc_id",
        F.col("s.n_words").alias("n_words"),
        F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a + b["places"]).alias("n_base"),
        F.array_min(F.transform(places, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(places, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("s.found.labels"))), ",").alias("labels"),
        F.coalesce(F.get(F.array(*[F.lit(x) for x in SCORES]), best - 1), F.lit(0.0)).alias("score"),
        F.col("s.found.n").alias("n_detections"),
    )
