"""Connected components of a distributed graph by large-star and small-star rounds (Kiveris et al., 2014).

Both steps are joins and minima with partial aggregates; a hub's neighbours are never gathered. The minima are written before
the join, so both of its sides are read from tables and Spark splits a hub's partition. Each round's edges are written to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_now, materialize


def _large_star(e: DataFrame) -> DataFrame:
    """e: (u, v). Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """e: (u, v) with v < u. u and its smaller neighbours are linked to the least of them."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v), the component's least node being its name.

    Nodes without edges have no row. Loops and repeated edges do no harm.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark, old = now, e
        wide = materialize(_large_star(e), "edges")
        e = materialize(_small_star(wide), "edges")
        drop_now(old)
        drop_now(wide)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
