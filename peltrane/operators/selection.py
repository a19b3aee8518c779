"""Joint selection of features by information gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.36
STEPS = 4096  # rank buckets per bit of gain


def union_gains(*gains: DataFrame) -> DataFrame:
    """Gains (kind, token, ig) together; of equal (kind, token) the first frame's row stays."""
    tagged = [g.select("kind", "token", "ig", F.lit(i).alias("_from")) for i, g in enumerate(gains)]
    whole = tagged[0]
    for g in tagged[1:]:
        whole = whole.unionByName(g)
    first = F.row_number().over(Window.partitionBy("kind", "token").orderBy("_from", F.desc("ig")))
    return whole.withColumn("_first", first).where("_first = 1").select("kind", "token", "ig")


def ccdf(gains: DataFrame) -> DataFrame:
    """Gains with ccdf = 1 - rank / n, the rank being the place in order of (ig, kind, token).

    Places are counted inside narrow buckets of ig, after the sizes of the buckets below: no single task orders all.
    """
    bucketed = gains.withColumn("_bucket", F.floor(F.col("ig") * STEPS))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    every = Window.partitionBy(F.lit(0))  # buckets, a few thousand for each bit of gain
    sizes = sizes.withColumn("_below", F.sum("_size").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).withColumn("_n", F.sum("_size").over(every))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("ig", "kind", "token"))
    ranked = bucketed.withColumn("_place", place).join(sizes, "_bucket")
    return ranked.select("kind", "token", "ig", (1 - (F.col("_below") + F.col("_place")) / F.col("_n")).alias("ccdf"))


def elbow(ranked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first place whose gain reaches the threshold; no row if none does."""
    return ranked.where(F.col("ig") >= threshold).orderBy("ig", "kind", "token").limit(1)


def select_features(gains: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Strictly above the threshold, in order of gain."""
    return gains.where(F.col("ig") > threshold)


def top_gains(gains: DataFrame, k: int) -> DataFrame:
    return gains.orderBy(F.desc("ig"), F.asc("token")).limit(k)
