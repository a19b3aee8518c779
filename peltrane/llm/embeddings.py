"""Embedding near-dedup: subspace pigeonhole join.

cosine >= t means that unit vectors lie within squared distance D = 2 - 2 t. The vectors are rotated (a seeded orthogonal
matrix for each dimension) and split into low-dimensional blocks. If two vectors are within D, then in some block b of
d_b of the d coordinates they are within D * d_b / d. So each block is range-joined under that budget on a grid, and the union of
the candidates is verified exactly, in double precision.

The grid has cells of `width` radii. A vector stands in its home cell and probes the cells that its ball reaches; of two cells
only the lower probes the higher, so a pair meets once in a block. The join's condition checks the block's budget on its
coordinates before a candidate comes out. Equal vectors of a label are one class throughout; copies are counted, not paired.

Null labels, null or empty vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
different dimensions never link. Each row counts as a vector, repeated rows and null ids included (a component without any
id has component_id null and kept null). Columns other than the three named are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row_id
from .components import components

COSINE, BLOCK_DIMS, WIDTH, SEED = 0.98, 8, 4.0, 5
SLACK = 1e-9  # on squared distances, above the rounding of the rotation
ROUNDING = 1e-3  # on squared distances in radii, above that of single precision


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))[0]


def blocks(d: int, dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    return [(a, min(a + dims, d)) for a in range(0, d, dims)]


def _unit_rows(vectors: pa.Array) -> list[bytes | None]:
    """Each vector over its norm, as doubles; None if it links with nothing."""
    out: list[bytes | None] = []
    for x in vectors.to_pylist():
        if not x or None in x:
            out.append(None)
            continue
        v = np.array(x, dtype=np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        if not 1e-100 < top < 1e100:
            v = v / top
        out.append((v / np.sqrt(v @ v)).tobytes())
    return out


def unit_vectors(rows: DataFrame) -> DataFrame:
    """rows (_rid, vec_id, label, embedding) with `unit` instead of the embedding."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(_unit_rows(b.column(3)), type=pa.binary())], names=["_rid", "vec_id", "label", "unit"])

    return rows.mapInArrow(run, f"_rid long, vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")


def _cells(units: np.ndarray, budget: float, dims: int, width: float, probes: bool):
    """For each block: rows, whether it is the home cell, hashes of cells, coordinates in radii. Without probes, home cells alone."""
    d = units.shape[1]
    turned = units @ rotation(d)
    for k, (a, b) in enumerate(blocks(d, dims)):
        x = turned[:, a:b] / np.sqrt(budget * (b - a) / d + SLACK)
        home = np.floor(x / width).astype(np.int64)
        rows, cells = np.arange(len(x)), home
        if probes:
            low, high = np.floor((x - 1) / width).astype(np.int64), np.floor((x + 1) / width).astype(np.int64)
            cells = np.empty((len(x), 0), dtype=np.int64)
            for j in range(b - a):  # a ball reaches at most two cells a coordinate, as cells are wider than it
                two = low[rows, j] != high[rows, j]
                cells = np.concatenate([np.column_stack([cells, low[rows, j]]), np.column_stack([cells[two], high[rows[two], j]])])
                rows = np.concatenate([rows, rows[two]])
        order = np.zeros(len(rows), dtype=np.int64)
        for j in range(b - a):
            order = np.where(order == 0, np.sign(cells[:, j] - home[rows, j]), order)
        rows, cells, order = rows[order >= 0], cells[order >= 0], order[order >= 0]
        key = np.full(len(rows), d * 65_537 + k, dtype=np.uint64)
        for j in range(b - a):
            key = (key ^ (cells[:, j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        yield rows, order == 0, key, x.astype(np.float32)


def cell_rows(classes: DataFrame, budget: float, dims: int, width: float, probes: bool) -> DataFrame:
    """classes (node, label, unit) to the cells that each stands in or probes: key, node, home, coordinates in radii."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                node, label, unit = np.array(batch.column(0)), np.array(batch.column(1)).view(np.uint64), batch.column(2).to_pylist()
                lengths = np.array([len(u) // 8 for u in unit])
                for d in np.unique(lengths):
                    own = np.flatnonzero(lengths == d)
                    matrix = np.frombuffer(b"".join(unit[i] for i in own), dtype=np.float64).reshape(len(own), d)
                    for rows, home, key, x in _cells(matrix, budget, dims, width, probes):
                        key = (key ^ label[own[rows]]) * np.uint64(0x94D049BB133111EB)
                        columns = [x[rows, j] if j < x.shape[1] else np.zeros(len(rows), np.float32) for j in range(dims)]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[own[rows]]), pa.array(home), *map(pa.array, columns)], names=["key", "node", "home", *[f"x{j}" for j in range(dims)]])

    schema = "key long, node long, home boolean, " + ", ".join(f"x{j} float" for j in range(dims))
    return classes.select("node", F.xxhash64("label").alias("label"), "unit").mapInArrow(run, schema)


def candidates(classes: DataFrame, budget: float, dims: int, width: float) -> DataFrame:
    """(u, v), u < v: pairs of nodes within the budget in some block. Cells meet by a hash of label, block and cell numbers."""
    a, b = (cell_rows(classes, budget, dims, width, probes).alias(n) for n, probes in (("a", False), ("b", True)))
    once = (~F.col("b.home") & (F.col("a.node") != F.col("b.node"))) | (F.col("a.node") < F.col("b.node"))
    gap = sum((F.pow(F.col(f"a.x{j}").cast("double") - F.col(f"b.x{j}"), 2) for j in range(dims)), F.lit(0.0))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & once & (gap <= 1 + ROUNDING)).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The candidate pairs of one label and dimension whose cosine, in double precision, reaches the threshold."""
    units = classes.select("node", "label", "unit")
    both = pairs.join(units.withColumnsRenamed({"node": "u", "label": "xl", "unit": "x"}), "u").join(units.withColumnsRenamed({"node": "v", "label": "yl", "unit": "y"}), "v")
    both = both.where((F.col("xl") == F.col("yl")) & (F.octet_length("x") == F.octet_length("y"))).select("u", "v", "x", "y")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x, y = (b.column(c).to_pylist() for c in (2, 3))
                keep = np.fromiter((float(np.frombuffer(p) @ np.frombuffer(q)) >= cosine for p, q in zip(x, y, strict=True)), bool, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(run, "u long, v long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_dims: int = BLOCK_DIMS, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (it is that one)."""
    rows = with_row_id(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")))
    rows = materialize(unit_vectors(rows.select("_rid", "vec_id", "label", "embedding")), "units")
    able = F.col("unit").isNotNull() & F.col("label").isNotNull()
    classes = materialize(rows.where(able).groupBy("label", "unit").agg(F.min("_rid").alias("node"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    edges = materialize(verified(candidates(classes, 2 - 2 * cosine, block_dims, width), classes, cosine), "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    copies = classes.select(F.col("node").alias("v"), F.col("copies").alias("n"))
    degree = both.join(copies, "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    found = components(edges)
    named = classes.join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("label", "unit", "component", "first", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "class-components")
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = named.join(firsts, "component").select(F.col("label").alias("_label"), F.col("unit").alias("_unit"), "n_links", "component_id")
    joined = rows.join(table, (F.col("label") == F.col("_label")) & (F.col("unit") == F.col("_unit")), "left")
    component = F.when(able, F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: All pairs of a label, and the closure of their links.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT rid, vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.rid AS i, b.rid AS j FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT rid AS i, rid AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.j GROUP BY r.i),
d AS (SELECT i AS rid, count(*) AS n_links FROM l GROUP BY i)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN d USING (rid)
"""
