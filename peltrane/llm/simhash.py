"""SimHash near-dedup with deletion-variant signatures.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 4-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if
set in over half of the hashes. A text without words has fingerprint zero, one with fewer words than a shingle the hash of
all of them.

Links: two fingerprints at 4 or fewer differing bits. 64 bits are cut into 3 segments, so in one of them two linked
fingerprints differ by at most one bit. Each fingerprint is indexed by all its one-wildcard segment variants (64: one bit of
one segment masked out); an equality join on variants meets every such pair; the join itself verifies the distance and
keeps a pair only at its first variant, so each link comes out once. Equal fingerprints are one node throughout: copies
are never paired. Components are found on the distributed links.

A null or empty text has fingerprint zero and is linked like any other. Null ids keep their rows and name a component only
if nothing else is in it (component_id null). Repeated rows keep their rows. Texts are whole. Columns other than the two
named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, spread, with_row_id
from .components import components

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    data = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    words = data.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows (_rid, doc_id, text) to _rid, doc_id and fp: the fingerprint as a signed long."""
    rows = spread(rows.select("_rid", "doc_id", "text")).select("_rid", "doc_id", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["_rid", "doc_id", "fp"])

    return rows.mapInArrow(run, f"_rid long, doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def segments(distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, end) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [bits * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fp: Column, distance: int = DISTANCE) -> Column:
    """All one-wildcard segment variants: (masked bit, what is left of its segment)."""
    out = []
    for a, b in segments(distance):
        mask = (1 << b) - (1 << a)
        out += [F.struct(F.lit(j).alias("bit"), fp.bitwiseAND(F.lit(_signed(mask & ~(1 << j))).cast("long")).alias("rest")) for j in range(a, b)]
    return F.array(*out)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): all pairs of the distinct fingerprints `fp` at `distance` or fewer differing bits, once each."""
    index = fps.select("fp", F.explode(variants(F.col("fp"), distance)).alias("x")).select("fp", "x.bit", "x.rest")
    index = index.hint("merge")  # Spark takes the index to be as small as the fingerprints it is made of, and would broadcast it
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(-1)  # the variant that the pair is kept at: the first segment with at most one differing bit
    for s, e in reversed(segments(distance)):
        part = x.bitwiseAND(F.lit(_signed((1 << e) - (1 << s))).cast("long"))
        place = F.when(part == 0, F.lit(s)).when(part < 0, F.lit(63)).otherwise(F.bit_count(part - 1))
        first = F.when(F.bit_count(part) <= 1, place).otherwise(first)
    same = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest"))
    return a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= distance) & (F.col("a.bit") == first)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _named(rows: DataFrame, distance: int) -> DataFrame:
    """rows: fingerprints(). (fp, component): a component is named by its least fingerprint."""
    distinct = materialize(rows.select("fp").distinct(), "fps")
    found = components(links(distinct, distance))
    return materialize(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component")), "fp-components")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows = materialize(fingerprints(with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))), "simhash")
    named = _named(rows, distance)
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named, "fp").groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    table = materialize(named.join(firsts, "component").select("fp", "component_id"), "fp-names")  # tables, so hot keys are split
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs without all but one row of each component: the smallest id's (null last), of equal ids the first row's."""
    whole, (doc_id, text), back = boxed(docs, id_col, text_col)
    rows = materialize(fingerprints(whole.select("_rid", doc_id.alias("doc_id"), text.alias("text"))), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    least = rows.groupBy("fp").agg(F.min(key).alias("least")).join(_named(rows, distance), "fp")
    kept = least.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("_rid"))
    gone = materialize(rows.select("_rid").join(kept, "_rid", "left_anti"), "copies")
    return whole.join(gone, "_rid", "left_anti").select(*back)
