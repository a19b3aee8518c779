"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes are words `[^\\x20\\x09-\\x0D]+`. Sources by code point, null last, get the weights in turn. Targets share the
   total by weight; a target stops at max_repeat times its source's size and the excess is shared again (water-filling,
   solved in closed form over the sources ordered by cap / weight).
2. The total is cut into blocks of block_words words. Blocks go to sources by highest quotients target / (2 k + 1). Rounding
   gives all but a few of them; only about five quotients of each source are ranked.
3. Each source is dealt into shards by a seeded hash of the document, one per shard_words words, so a hot source has as
   many shards as its size asks for. Its blocks go to its shards by the same rule on the shards' sizes.
4. In a shard the documents stand in seeded order and are cut into blocks; a quota of q blocks takes whole rounds of the
   shard and, for the rest, consecutive blocks from a seeded one on (around the end). Each document's words among
   them are arithmetic on its running sum, so no row per block is made.

All in Spark's own expressions. The table of sources and the table of (source, shard) are aggregates, not rows of
documents. Reruns agree: order and choice depend on the seed and the documents alone.

A null text has size 0 and takes nothing; a null source is a source; repeated rows keep a row each; an empty table gives
an empty result; columns not named are ignored (mixed_documents() hands them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, boxed, materialize, spread

WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
BLOCK_WORDS, SHARD_WORDS, SEED = 8, 1 << 20, 17


def word_count(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(flat == "", F.lit(0).cast("long")).otherwise((F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long"))


def seeded(*parts: Column) -> Column:
    """A hash of the parts, 0 to 2^60: md5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def apportion(rows: DataFrame, within: list[str], claim: Column, seats: Column, out: str) -> DataFrame:
    """rows with `out`: the seats of each row in its group, by highest quotients claim / (2 k + 1). seats: of the group.

    Claims over the divisor that gives T seats, rounded, are T seats up to half the number of rows. So with T less and more than the
    group's seats by 3 / 2 of the rows (a margin for rounded doubles), each row's seats lie between two numbers, and only the
    quotients between them are ranked: some 5 for each row, whatever the claims.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    share = rows.withColumn("_claim", claim.cast("double")).withColumn("_seats", seats.cast("long"))
    share = share.withColumn("_sum", F.sum("_claim").over(group)).withColumn("_margin", 1.5 * F.count(F.lit(1)).over(group) + 1)
    rounded = lambda t: F.floor(F.col("_claim") * F.greatest(F.lit(0.0), t) / F.col("_sum") + 0.5).cast("long")
    share = share.withColumn("_low", F.when(F.col("_claim") > 0, rounded(F.col("_seats") - F.col("_margin"))).otherwise(F.lit(0).cast("long")))
    ks = F.when(F.col("_claim") > 0, F.sequence(F.col("_low"), rounded(F.col("_seats") + F.col("_margin")))).otherwise(F.array().cast("array<bigint>"))
    key = [*within, "_key"]
    tried = share.select(*key, "_claim", "_low", "_seats", F.explode(ks).alias("_k")).withColumn("_q", F.col("_claim") / (2 * F.col("_k") + 1))
    left = F.col("_seats") - F.sum(F.when(F.col("_k") == F.col("_low"), F.col("_low"))).over(group)
    rank = F.row_number().over((Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(F.desc("_q"), F.asc("_key"), F.asc("_k")))
    won = tried.withColumn("_left", left).withColumn("_rank", rank).groupBy(*key).agg((F.first("_low") + F.sum((F.col("_rank") <= F.col("_left")).cast("long"))).alias(out))
    return rows.join(won, key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """_source, source_size, target, _key. sizes: _source, size. One row per source."""
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # one row per source, not of documents
    turn = F.row_number().over(every.orderBy(F.asc_nulls_last("_source")))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights)).cast("int"))
    t = sources.withColumn("_key", turn.cast("long")).withColumn("_w", w).withColumn("_cap", (max_repeat * F.col("source_size")).cast("double"))
    t = t.withColumn("_total", F.sum("source_size").over(every).cast("double"))
    before = every.orderBy(F.asc(F.col("_cap") / F.col("_w")), F.asc("_key")).rowsBetween(Window.unboundedPreceding, -1)
    onward = every.orderBy(F.asc(F.col("_cap") / F.col("_w")), F.asc("_key")).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    t = t.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    whole = every.orderBy(F.asc(F.col("_cap") / F.col("_w")), F.asc("_key")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(whole)  # the first level that its own source can bear
    return t.withColumn("target", F.when(held.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), held * F.col("_w")))).select("_source", "_key", "source_size", "target", "_total")


def mix_sizes(rows: DataFrame, *, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """rows (_source, size, _tie and others) with source_size, target, taken. _tie: a hash that orders the documents."""
    sources = source_targets(rows, weights, max_repeat)
    sources = apportion(sources, [], F.col("target"), F.round(F.col("_total") / block_words), "_blocks")
    sources = materialize(sources.withColumn("_shards", F.ceil(F.col("source_size") / shard_words).cast("long")).drop("_total"), "mix-sources")
    dealt = rows.join(sources.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    dealt = dealt.withColumn("_shard", seeded(F.lit(seed), F.lit("shard"), F.col("_tie")) % F.greatest(F.lit(1).cast("long"), F.col("_shards")))
    cells = dealt.groupBy(F.col("_key").alias("_in"), F.col("_shard").alias("_key")).agg(F.sum("size").alias("_cell"), F.first("_blocks").alias("_blocks"))
    cells = apportion(cells, ["_in"], F.col("_cell"), F.col("_blocks"), "_quota")
    cells = cells.select("_in", F.col("_key").alias("_cell_shard"), F.col("_cell"), F.least(F.col("_quota") * block_words, max_repeat * F.col("_cell")).alias("_words"))
    placed = Window.partitionBy("_key", "_shard").orderBy(seeded(F.lit(seed), F.lit("order"), F.col("_tie")), "_tie", "size")
    run = dealt.withColumn("_end", F.sum("size").over(placed.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(cells, (F.col("_key") == F.col("_in")) & (F.col("_shard") == F.col("_cell_shard")))
    n, words = F.greatest(F.col("_cell"), F.lit(1).cast("long")), F.col("_words")
    rounds, rest = F.floor(words / n), words % n
    first = block_words * (seeded(F.lit(seed), F.lit("first"), F.col("_key"), F.col("_shard")) % F.ceil(n / block_words))
    start = F.col("_end") - F.col("size")
    overlap = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(b, first + rest) - F.greatest(a, first))
    taken = rounds * F.col("size") + overlap(start, F.col("_end")) + overlap(start + n, F.col("_end") + n)
    return run.withColumn("taken", taken.cast("long"))


def _sized(docs: DataFrame, key: Column, doc_id: Column, text: Column, source: Column) -> DataFrame:
    tie = F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(text.cast("binary")), source).cast("binary"))
    return materialize(docs.select(key, source.alias("_source"), word_count(text).alias("size"), tie.alias("_tie")), "mix-sizes")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = _sized(spread(docs.select(*dict.fromkeys([id_col, text_col, source_col]))), F.col(id_col).alias("doc_id"), F.col(id_col), F.col(text_col), F.col(source_col))
    return mix_sizes(rows, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, each repeated as often as the mix takes it: whole texts, the part of one that a quota's edge cuts rounded.

    Only documents cut by an edge are rounded, two for each shard at most. What is decided is joined back by row number.
    """
    rows, fields, back = boxed(docs, id_col, text_col, source_col)
    slim = _sized(spread(rows), F.col("_rid"), *fields)
    copies = mix_sizes(slim, **options).where("taken > 0").select("_rid", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies")).where("_copies > 0")
    return rows.join(copies, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*back)


_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
#: The definitions in SQL: all quotients are ranked there.
ORACLE = f"""
WITH d AS (SELECT doc_id, source AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS BIGINT) AS size,
  md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(text), source)) AS tie FROM documents),
s0 AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(s) NULLS LAST) AS k, CAST({MAX_REPEAT} * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, CAST({list(WEIGHTS)}[1 + (k - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT arg_min(level, (cap / w, k)) AS level FROM s3 WHERE level * w <= cap),
s5 AS (SELECT s3.* EXCLUDE (level), CASE WHEN s4.level IS NULL THEN cap ELSE least(cap, s4.level * w) END AS target, CAST(ceil(source_size / {SHARD_WORDS}.0) AS BIGINT) AS shards FROM s3, s4),
q1 AS (SELECT k, j, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, k, j) AS r, round(total / {BLOCK_WORDS}) AS n FROM (SELECT *, unnest(generate_series(0, CAST(cap / {BLOCK_WORDS} AS BIGINT) + 1)) AS j FROM s5 WHERE target > 0)),
b AS (SELECT k, count(*) AS blocks FROM q1 WHERE r <= n GROUP BY k),
x AS (SELECT d.*, k, source_size, target, CAST({_HASH.format(f"concat_ws('|', '{SEED}', 'shard', tie)")} % greatest(1, shards) AS BIGINT) AS shard FROM d JOIN s5 ON d.s IS NOT DISTINCT FROM s5.s),
c AS (SELECT k, shard, CAST(sum(size) AS BIGINT) AS cell FROM x GROUP BY k, shard),
q2 AS (SELECT k, shard, row_number() OVER (PARTITION BY k ORDER BY cell / (2 * j + 1) DESC, shard, j) AS r, coalesce(blocks, 0) AS n FROM (SELECT *, unnest(generate_series(0, CAST({MAX_REPEAT} * cell / {BLOCK_WORDS} AS BIGINT) + 50)) AS j FROM c WHERE cell > 0) LEFT JOIN b USING (k)),
q3 AS (SELECT k, shard, count(*) FILTER (WHERE r <= n) AS quota FROM q2 GROUP BY k, shard),
z AS (SELECT k, shard, cell, least(coalesce(quota, 0) * {BLOCK_WORDS}, {MAX_REPEAT} * cell) AS words, greatest(cell, 1) AS n,
  {BLOCK_WORDS} * CAST({_HASH.format(f"concat_ws('|', '{SEED}', 'first', CAST(k AS VARCHAR), CAST(shard AS VARCHAR))")} % CAST(ceil(greatest(cell, 1) / {BLOCK_WORDS}.0) AS BIGINT) AS BIGINT) AS a FROM c LEFT JOIN q3 USING (k, shard)),
y AS (SELECT *, words // n AS rounds, words % n AS rest, sum(size) OVER (PARTITION BY k, shard ORDER BY {_HASH.format(f"concat_ws('|', '{SEED}', 'order', tie)")}, tie, size ROWS UNBOUNDED PRECEDING) AS e FROM x JOIN z USING (k, shard))
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(e, a + rest) - greatest(e - size, a)) + greatest(0, least(e + n, a + rest) - greatest(e - size + n, a)) AS BIGINT) AS taken FROM y
"""
