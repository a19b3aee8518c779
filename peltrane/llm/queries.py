"""The registered queries of the training-data operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from . import embeddings, license_scan, mixing, packing, pii, quality_rules, simhash, suffix_dedup, token_counts, url_filters
from .common import table


def pii_key(spark) -> str:
    """The session's key; synthetic tables need no secret one."""
    return spark.conf.get("spark.peltrane.pii.key", "synthetic tables only")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pii(spark, sf_dir):
    return pii.surrogates(table(spark, sf_dir, "documents"), key=pii_key(spark))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_url_filters, op3_packing, op4_mixing, op5_quality_rules, op6_simhash, op7_token_counts, op8_license_scan, op9_embeddings, op10_pii)
}
ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_url_filters": url_filters.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op9_embeddings": embeddings.ORACLE,
}
