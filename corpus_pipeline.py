"""The corpus pipeline: documents in, packed sequences out.

Stages, each on all that its predecessor kept: quality rules drop the documents that fail, with their host or alone;
near-dedup (op6: SimHash fingerprints at 4 or fewer differing bits, by deletion variants) leaves one document of each group; PII is replaced by surrogates; sources are mixed to the target
weights, whole documents being repeated or left out; what is left is packed. All but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from peltrane.llm import mixing, packing, pii, quality_rules, simhash
from peltrane.llm.common import materialize, table
from peltrane.llm.queries import pii_key


def quality(spark, docs, sf_dir):
    return quality_rules.quality_filter(docs)


def near_dedup(spark, docs, sf_dir):
    return simhash.one_of_each(docs)


def private_data(spark, docs, sf_dir):
    return pii.surrogates(docs, key=pii_key(spark), columns=True)


def mixture(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("private_data", private_data), ("mixture", mixture), ("packing", pack)]

#: Surrogates and packing can't be expressed in SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
