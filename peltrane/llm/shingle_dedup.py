"""Near-dedup by the similarity of five-word shingles, exact and complete.

A text's shingles: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, all runs of five words, each known by 64 hashed bits; a text with fewer
words has one shingle of all of them. Two texts are linked if the sets' intersection is at least 0.8 of their union. Texts of equal
sets are one node throughout: copies are never paired.

Candidates: of two sets with that similarity, the least ceil(0.2 n) or so shingles of each, in any order common to all texts,
share one (prefix filter), so no pair is missed. The order puts shingles that a sample of the texts has often last, so
passages that many texts hold are seldom in a prefix; the sample changes the work, not the result. Places of the shared shingle
bound the intersection, which drops most other candidates; the rest are verified on whole sets.

Members of a bucket are first paired with one of them (the smallest, for each text one such pair; then all; then the largest); then
only pairs of different components so far are left, and all of them are verified. So a group of near copies costs no square of its size.

A null or empty text has no shingles; such texts are copies of each other. Null ids and repeated rows are rows like any other.
Texts are whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, drop_now, free_shuffles, materialize, spread
from .components import components

SHINGLE, SEED = 5, 42
#: Similarity of 0.8: 9 times the intersection is at least 4 times the sum of the sizes.
#: The sample is every 16th text of many; so many of its shingles, met so often, come last in the order.
SAMPLE, SAMPLE_ROWS, COMMON, OFTEN = 16, 8192, 1 << 18, 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str | bytes | None) -> np.ndarray:
    """The distinct hashed shingles of one text, sorted, signed."""
    import xxhash

    data = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    words = data.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return np.empty(0, np.int64)
    one = xxhash.xxh64_intdigest
    w = np.fromiter((one(x, SEED) for x in words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _ODD[j]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def _binary(rows: DataFrame) -> DataFrame:
    return spread(rows.select("_rid", "doc_id", "text")).select("_rid", "doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *parts]))).cast(pa.list_(pa.int64()))


def sets(rows: DataFrame) -> DataFrame:
    """rows (_rid, doc_id, text) to _rid and set."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(x.as_py()) for x in b.column(2)])], names=["_rid", "set"])

    return _binary(rows).mapInArrow(run, "_rid long, set array<long>")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles that a sample has often, the most frequent last."""
    every = max(1, min(SAMPLE, rows.count() // SAMPLE_ROWS))
    some = sets(rows.where(F.pmod(F.xxhash64("_rid"), F.lit(every)) == 0))
    often = some.select(F.explode("set").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    return often.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()["h"].to_numpy().astype(np.int64)[::-1].copy()


def signatures(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """rows to _rid, doc_id, the set's key and size n, and its prefix in the order."""
    place = np.argsort(common)
    known = common[place]

    def prefix(h: np.ndarray) -> np.ndarray:
        n = len(h) and len(h) - (4 * len(h) + 4) // 5 + 1
        if not (n and len(known)):
            return h[:n]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return h[np.lexsort((h, np.where(known[at] == h, place[at] + 1, 0)))[:n]]

    def run(batches):
        import xxhash

        for b in batches:
            found = [shingles(x.as_py()) for x in b.column(2)]
            keys = pa.array([xxhash.xxh128_digest(h.tobytes()) for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, pa.array([len(h) for h in found], pa.int32()), _lists([prefix(h) for h in found])], names=["_rid", "doc_id", "key", "n", "prefix"])

    rows = _binary(rows)
    return rows.mapInArrow(run, f"_rid long, doc_id {dict(rows.dtypes)['doc_id']}, key binary, n int, prefix array<long>")


def _possible(a: str, b: str) -> Column:
    """Whether a shared shingle can be the first one shared: from it on, the lesser rest must hold the whole intersection."""
    return 9 * F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest")) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _pairs(x: DataFrame, a: str, b: str) -> DataFrame:
    return x.select(F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v")).distinct()


def _star(members: DataFrame, order: list) -> DataFrame:
    """Each member of a bucket with the bucket's first one, unless they are of one component."""
    me = F.struct("node", "n", "rest", "component")
    both = members.select(me.alias("b"), F.first(me).over(Window.partitionBy("h").orderBy(*order)).alias("a"))
    return _pairs(both.where((F.col("a.component") != F.col("b.component")) & _possible("a", "b")), "a", "b")


def _crossed(members: DataFrame) -> DataFrame:
    """All pairs of a bucket's members of different components. No pair of one component is met."""
    own = materialize(members.select("h", "component").distinct(), "bucket-components")
    two = own.alias("p").join(own.alias("q"), (F.col("p.h") == F.col("q.h")) & (F.col("p.component") < F.col("q.component"))).select(F.col("p.h").alias("h"), F.col("p.component").alias("p"), F.col("q.component").alias("q"))
    a = two.join(members.alias("a"), (two.h == F.col("a.h")) & (two.p == F.col("a.component"))).select(two.h.alias("h"), "q", F.struct("a.node", "a.n", "a.rest").alias("a"))
    both = a.join(members.alias("m"), (a.h == F.col("m.h")) & (a.q == F.col("m.component"))).select("a", F.struct("m.node", "m.n", "m.rest").alias("b"))
    return _pairs(both.where(_possible("a", "b")), "a", "b")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) of rows that are similar."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("_rid")).distinct()
    whole = materialize(sets(rows.join(needed, "_rid", "left_semi")), "sets")
    a, b = whole.select(F.col("_rid").alias("u"), F.col("set").alias("a")), whole.select(F.col("_rid").alias("v"), F.col("set").alias("b"))
    similar = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))
    out = materialize(pairs.join(a, "u").join(b, "v").where(similar).select("u", "v"), "links")
    drop_now(whole)
    return out


def _thin(pairs: DataFrame) -> DataFrame:
    """One pair for each v."""
    return pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")


def links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): similar pairs whose components are those of all similar pairs. members: (h, node, n, rest)."""
    found = tested = None
    smallest = [F.col("n"), F.col("node")]
    for candidates in (lambda m: _thin(_star(m, smallest)), lambda m: _star(m, smallest), lambda m: _star(m, [F.desc("n"), F.desc("node")]), _crossed):
        if found is None:
            now = members.withColumn("component", F.col("node"))
        else:
            named = members.join(components(found).withColumnRenamed("component", "_of"), "node", "left").select("h", "node", "n", "rest", F.coalesce("_of", "node").alias("component"))
            named = materialize(named, "members")
            mixed = named.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("h")
            now = materialize(named.join(mixed, "h", "left_semi"), "mixed")
            drop_now(named)
        pairs = candidates(now)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        good = verified(pairs, rows)
        free_shuffles(rows.sparkSession)
        found = good if found is None else found.unionByName(good)
        tested = pairs if tested is None else tested.unionByName(pairs)
    return found


def _members(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, node, n, rest): the prefixes' shingles that several nodes have."""
    index = signed.join(nodes.select(F.col("node").alias("_rid")), "_rid", "left_semi").select(F.col("_rid").alias("node"), "n", F.posexplode("prefix").alias("place", "h"))
    bucket = Window.partitionBy("h").orderBy("n", "node")
    near = index.select("h", "node", "n", (F.col("n") - F.col("place")).alias("rest"), F.lag("node").over(bucket).alias("_before"), F.lead("node").over(bucket).alias("_after"))
    return materialize(near.where("_before IS NOT NULL OR _after IS NOT NULL").drop("_before", "_after"), "members")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component: the smallest id's (null last), of equal ids the first row's."""
    whole, (doc_id, text), back = boxed(docs, id_col, text_col)
    rows = whole.select("_rid", doc_id.alias("doc_id"), text.alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    signed = materialize(signatures(rows, common_shingles(rows)), "shingles")
    keys = materialize(signed.select("_rid", "doc_id", "key"), "keys")
    nodes = materialize(keys.groupBy("key").agg(F.min("_rid").alias("node"), F.min(key).alias("least")), "nodes")
    members = _members(signed, nodes)
    drop_now(signed)
    free_shuffles(docs.sparkSession)
    named = nodes.join(components(links(members, rows)).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("least", F.coalesce("component", "node").alias("component"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("_rid"))
    gone = materialize(keys.select("_rid").join(kept, "_rid", "left_anti"), "copies")
    return whole.join(gone, "_rid", "left_anti").select(*back)
