"""The registered queries over the driver's tables and the same in SQL.

Roles: documents are files (bytes of the text, language as family), orders with their lines are files with sections and
imports, a user's events in order are an instruction sequence. Every query runs over whole tables. Doubles are rounded
to six places and tokens returned as text, so that both engines give equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, tokens
from ..operators import groups, information, padding, selection, vocabulary
from ..sources import samples

#: Parameters that differ from the operators' defaults, as the tables hold other tokens than program files do.
IG_THRESHOLD = 0.05
PAD_TOP = 64
STANDARD_BRANDS = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31", "Brand#44", "Brand#45", "Brand#55")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(column) -> F.Column:
    return F.when(column % 100 < 62, "train").otherwise("test")


def _files(spark, sf_dir) -> DataFrame:
    """documents as files: doc_id, family, content."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family"), F.col("text").cast("binary").alias("content"))
    return samples.spread(d)


def _families(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family"))


def _r6(c) -> F.Column:
    return F.round(c, 6)


# -- Sources, projections, joins -----------------------------------------------------------------------------------


def scan_split(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("family"), _split(F.col("doc_id")).alias("split"))


def join_features_labels(spark, sf_dir):
    d, y = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return samples.join_labels(d.select("doc_id", "source", "n_chars"), y, "doc_id").select("doc_id", "source", "n_chars", "quality", "toxic")


def union_then_join(spark, sf_dir):
    d, y = scan_split(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    y = y.withColumn("split", _split(F.col("doc_id")))
    part = lambda f, s: f.where(F.col("split") == s)
    return samples.union_then_join([part(d, "train"), part(d, "test")], [part(y, "train").drop("split"), part(y, "test").drop("split")], "doc_id").select("doc_id", "family", "split", "quality")


def error_filter(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("event_type")))
    return e.where(F.col("error").isNull()).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def size_filter(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return vocabulary.size_limit(d, 0.002).select("doc_id", "length", _r6(scalars.megabytes(F.col("length"))).alias("mb"))


# -- Strings ---------------------------------------------------------------------------------------------------------


def _strings(spark, sf_dir) -> DataFrame:
    return tokens.string_tokens(_files(spark, sf_dir), sample="doc_id", content="content")


def strings_extract(spark, sf_dir):
    return _strings(spark, sf_dir).select("doc_id", F.concat(F.lit("str_"), "token").alias("token"))


def string_docfreq(spark, sf_dir):
    return vocabulary.document_frequency(_strings(spark, sf_dir)).select("token", "df")


def string_topk(spark, sf_dir):
    n = _table(spark, sf_dir, "documents").count()
    top = vocabulary.top_share(vocabulary.document_frequency(_strings(spark, sf_dir)), 0.0002)
    return top.select(F.concat(F.lit("str_"), "token").alias("token"), "df", _r6(F.col("df") / F.lit(float(n))).alias("prevalence"))


# -- Bytes -----------------------------------------------------------------------------------------------------------


def byte_entropy(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("generic_fileSize"), _r6(tokens.byte_entropy(F.col("content"))).alias("generic_fileEntropy"))


def _grams(spark, sf_dir) -> DataFrame:
    return tokens.byte_ngrams(_files(spark, sf_dir), sample="doc_id", content="content")


def ngram_distinct(spark, sf_dir):
    g = _grams(spark, sf_dir)
    return g.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.hex("token")).alias("first_gram"), F.max(F.hex("token")).alias("last_gram"))


def ngram_docfreq(spark, sf_dir):
    df = vocabulary.document_frequency(_grams(spark, sf_dir), ("size", "token"))
    return df.groupBy("size", "df").agg(F.count(F.lit(1)).alias("n_grams"))


def _prevalent_grams(spark, sf_dir) -> DataFrame:
    n = _table(spark, sf_dir, "documents").count()
    df = vocabulary.document_frequency(_grams(spark, sf_dir), ("size", "token"))
    return vocabulary.prevalent(df, vocabulary.absolute_bounds(n))


def ngram_prevalence(spark, sf_dir):
    return _prevalent_grams(spark, sf_dir).select("size", F.hex("token").alias("gram"), "df")


def _gram_gains(spark, sf_dir) -> DataFrame:
    """(size, token, df, ig) of the prevalent n-grams, in one pass over the files."""
    files = _files(spark, sf_dir)
    grams = tokens.byte_ngrams(files, sample="doc_id", content="content", carry=("family",))
    n = _table(spark, sf_dir, "documents").count()
    return information.labelled_gain(grams, _families(spark, sf_dir), label="family", by=("size", "token"), bounds=vocabulary.absolute_bounds(n))


def ig_ngram(spark, sf_dir):
    return _gram_gains(spark, sf_dir).select("size", F.hex("token").alias("gram"), _r6("ig").alias("ig"))


# -- Imports ---------------------------------------------------------------------------------------------------------


def import_normalise(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    tail = F.get(F.array(F.lit(".DLL"), F.lit(".dll.x"), F.lit(".drv")), (F.col("p_partkey") % 3).cast("int"))
    named = p.select("p_partkey", F.concat("p_brand", tail).alias("dll"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("name"))
    return named.select("p_partkey", scalars.dll_name(F.col("dll")).alias("dll"), scalars.import_name(F.col("name")).alias("imp"))


def _imports(spark, sf_dir) -> DataFrame:
    """(o_orderkey, kind, token), repeats kept."""
    lines = _table(spark, sf_dir, "orders").select("o_orderkey").join(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = lines.join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    both = F.explode(F.array(F.struct(F.lit("dll").alias("kind"), scalars.dll_name(F.col("p_brand")).alias("token")), F.struct(F.lit("import").alias("kind"), scalars.import_name(F.col("p_type")).alias("token"))))
    return parts.select("o_orderkey", both.alias("x")).select("o_orderkey", "x.kind", "x.token")


def import_prevalence(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").count()
    df = vocabulary.occurrences(_imports(spark, sf_dir), ("kind", "token"))
    return vocabulary.prevalent(df, vocabulary.relative_bounds(n, 12.5)).select("kind", "token", "df")


def ig_import(spark, sf_dir):
    y = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"))
    pairs = _imports(spark, sf_dir).distinct()
    return information.information_gain(pairs, y, sample="o_orderkey", label="family", by=("kind", "token")).select("kind", "token", _r6("ig").alias("ig"))


# -- Sequences -------------------------------------------------------------------------------------------------------


def _sequences(spark, sf_dir) -> DataFrame:
    """(user_id, token, tf) of events in order."""
    return tokens.row_ngrams(_table(spark, sf_dir, "events"), sample="user_id", order=["ts", "event_id"], item="event_type")


def opcode_tf(spark, sf_dir):
    return _sequences(spark, sf_dir).select("user_id", F.concat(F.lit("opcode_"), "token").alias("token"), "tf")


def _train(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("user_id") % 100 < 62)  # the predefined split


def opcode_docfreq(spark, sf_dir):
    return vocabulary.document_frequency(_train(_sequences(spark, sf_dir))).select("token", "df")


def opcode_prevalence(spark, sf_dir):
    df = opcode_docfreq(spark, sf_dir)
    return vocabulary.prevalent(df, vocabulary.relative_bounds(df.count(), 1.0))


def opcode_docfreq_full(spark, sf_dir):
    known = opcode_prevalence(spark, sf_dir)
    return vocabulary.members(vocabulary.document_frequency(_sequences(spark, sf_dir)), known).select("token", "df")


def _sequence_gains(spark, sf_dir) -> DataFrame:
    seq = _sequences(spark, sf_dir)
    y = _table(spark, sf_dir, "events").select("user_id").distinct().withColumn("family", F.col("user_id") % 4)
    return information.tfidf_gain(seq, y, vocabulary.document_frequency(seq), y.count(), sample="user_id", label="family")


def ig_opcode(spark, sf_dir):
    return _sequence_gains(spark, sf_dir).select("token", _r6("ig").alias("ig"))


def tfidf(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = o.join(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    words = lines.join(_table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("token")), F.col("l_partkey") == F.col("p_partkey"))
    counts = words.groupBy("o_custkey", "token").agg(F.count(F.lit(1)).alias("tf"))
    n = counts.select("o_custkey").distinct().count()
    weighed = vocabulary.tfidf(counts, vocabulary.document_frequency(counts), n)
    return weighed.select("o_custkey", "token", "tf", "df", _r6("weight").alias("weight"))


# -- Selection -------------------------------------------------------------------------------------------------------


def _all_gains(spark, sf_dir) -> DataFrame:
    grams = _gram_gains(spark, sf_dir).select(F.lit("byte").alias("kind"), F.hex("token").alias("token"), _r6("ig").alias("ig"))
    seqs = _sequence_gains(spark, sf_dir).select(F.lit("opcode").alias("kind"), "token", _r6("ig").alias("ig"))
    return selection.union_gains(grams, seqs)


def ig_union_dedup(spark, sf_dir):
    return _all_gains(spark, sf_dir)


def ig_ccdf(spark, sf_dir):
    return selection.ccdf(_all_gains(spark, sf_dir)).select("kind", "token", "ig", _r6("ccdf").alias("ccdf"))


def ig_elbow(spark, sf_dir):
    return selection.elbow(ig_ccdf(spark, sf_dir), IG_THRESHOLD)


def ig_select(spark, sf_dir):
    return selection.select_features(_all_gains(spark, sf_dir), IG_THRESHOLD).orderBy("ig", "kind", "token")


# -- Vocabulary and padding ----------------------------------------------------------------------------------------


def _top_strings(spark, sf_dir, k: int = PAD_TOP) -> DataFrame:
    return vocabulary.top_k(vocabulary.document_frequency(_strings(spark, sf_dir)), k)


def vocab_semi(spark, sf_dir):
    return vocabulary.members(_strings(spark, sf_dir), _top_strings(spark, sf_dir), PAD_TOP)


def pad_presence(spark, sf_dir):
    words = [r["token"] for r in _top_strings(spark, sf_dir).collect()]  # PAD_TOP rows
    padded = padding.pad_presence(_families(spark, sf_dir).select("doc_id"), _strings(spark, sf_dir), words, sample="doc_id")
    return padded.select("doc_id", padding.bits_text(F.col("features")).alias("features"))


def vocab_sizes(spark, sf_dir):
    s = _strings(spark, sf_dir).select(F.lit("strings").alias("kind"), F.col("token"))
    o = _sequences(spark, sf_dir).select(F.lit("opcodes").alias("kind"), F.col("token"))
    i = _imports(spark, sf_dir).select("kind", "token")
    return s.unionByName(o).unionByName(i).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def subsample(spark, sf_dir):
    return vocabulary.subsample(_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family")), 1000, key="doc_id")


# -- Sections and headers --------------------------------------------------------------------------------------------


def group_stats(spark, sf_dir):
    part = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("sizes"), F.max(part).alias("entry"))
    files = _table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<double>")
    sizes = F.coalesce("sizes", none)
    again = F.when(F.col("entry").isNull(), none).otherwise(F.array("entry.l_quantity"))
    s = files.select("o_orderkey", F.size(sizes).cast("long").alias("n"), groups.part_stats(sizes, again).alias("s"))
    return s.select("o_orderkey", "n", _r6("s.mean").alias("mean_size"), _r6("s.min").alias("min_size"), _r6("s.max").alias("max_size"))


def bit_explode(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", *[scalars.bit(F.col("p_size"), k).alias(f"characteristics_bit{k}") for k in range(16)])


def std_flags(spark, sf_dir):
    name = F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.lit("none"))
    p = _table(spark, sf_dir, "part").withColumn("name", name)
    return p.select("p_partkey", scalars.section_exists(F.col("name")).alias("name_exists"), F.col("name").isin(*STANDARD_BRANDS).alias("name_isstandard"))


def flagship(spark, sf_dir):
    """One feature row per document: size, entropy, presence of the most frequent strings and of n-grams selected by gain."""
    files = _files(spark, sf_dir)
    words = [r["token"] for r in _top_strings(spark, sf_dir).collect()]  # PAD_TOP rows
    top = selection.top_gains(_gram_gains(spark, sf_dir).where(F.col("size") == 4).select(F.hex("token").alias("token"), _r6("ig").alias("ig")), PAD_TOP)
    grams = [r["token"] for r in top.collect()]  # PAD_TOP rows
    base = files.select("doc_id", "family", F.octet_length("content").cast("long").alias("generic_filesize"), _r6(tokens.byte_entropy(F.col("content"))).alias("generic_fileentropy"))
    rows = padding.pad_presence(base, _strings(spark, sf_dir), words, sample="doc_id", out="strings")
    known = [bytes.fromhex(g) for g in grams]
    own = tokens.byte_ngrams(files, sample="doc_id", content="content", sizes=(4,), only=known).select("doc_id", "token")
    rows = padding.pad_presence(rows, own, known, sample="doc_id", out="grams")
    return rows.select("doc_id", "family", "generic_filesize", "generic_fileentropy", padding.bits_text(F.col("strings")).alias("strings"), padding.bits_text(F.col("grams")).alias("grams"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_split, join_features_labels, union_then_join, error_filter, size_filter, strings_extract, string_docfreq, string_topk, byte_entropy,
        ngram_distinct, ngram_docfreq, ngram_prevalence, ig_ngram, import_normalise, import_prevalence, ig_import, opcode_tf, opcode_docfreq,
        opcode_prevalence, opcode_docfreq_full, ig_opcode, tfidf, ig_union_dedup, ig_ccdf, ig_elbow, ig_select, vocab_semi, pad_presence,
        vocab_sizes, subsample, group_stats, bit_explode, std_flags, flagship,
    )
}

# -- The same in SQL -------------------------------------------------------------------------------------------------

_STRINGS = """
s0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\t\\x20-\\x7e]{4,}')) AS t FROM documents),
s AS (SELECT DISTINCT doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS token FROM s0 WHERE length(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 3),
sdf AS (SELECT token, count(*) AS df FROM s GROUP BY token)"""
_GRAMS = """
b AS (SELECT doc_id, lang AS family, encode(text) AS b FROM documents),
g AS (SELECT DISTINCT doc_id, 4 AS size, hex(array_slice(b, i, i + 3)) AS gram FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 4)) AS i FROM b)
  UNION ALL SELECT DISTINCT doc_id, 6 AS size, hex(array_slice(b, i, i + 5)) AS gram FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 5)) AS i FROM b)),
gdf AS (SELECT size, gram, count(*) AS df FROM g GROUP BY size, gram),
gn AS (SELECT count(*) AS n FROM documents),
gp AS (SELECT size, gram, df FROM gdf, gn WHERE df > round_even(n / 100.0, 0) AND df < round_even(n * 99 / 100.0, 0))"""


def _gain_sql(name: str, pairs: str, labels: str, key: str, value: str = "") -> str:
    """Dense form: all classes of all tokens, the definition itself."""
    v = ", v" if value else ""
    return f"""
{name}_p AS ({pairs}), {name}_y AS ({labels}),
{name}_c AS (SELECT y, count(*) AS ny FROM {name}_y GROUP BY y),
{name}_n AS (SELECT sum(ny) AS n, -sum(ny / (SELECT sum(ny) FROM {name}_c) * log2(ny / (SELECT sum(ny) FROM {name}_c))) AS h FROM {name}_c),
{name}_k AS (SELECT {key}{v}, y, count(*) AS c FROM {name}_p JOIN {name}_y USING (sample) GROUP BY ALL),
{name}_z AS (SELECT {key}{", 0 AS v" if value else ""}, y, ny - coalesce(c, 0) AS c FROM (SELECT DISTINCT {key} FROM {name}_k) CROSS JOIN {name}_c LEFT JOIN (SELECT {key}, y, sum(c) AS c FROM {name}_k GROUP BY ALL) USING ({key}, y)),
{name}_a AS (SELECT {key}, {"v" if value else "1 AS v"}, y, c FROM {name}_k UNION ALL SELECT {key}, 0 AS v, y, c FROM {name}_z WHERE c > 0),
{name}_e AS (SELECT {key}, v, y, c, sum(c) OVER (PARTITION BY {key}, v) AS nv FROM {name}_a),
{name} AS (SELECT {key}, greatest(0.0, any_value(h) + sum(c * log2(c / nv)) / any_value(n)) AS ig FROM {name}_e, {name}_n GROUP BY {key})"""


_IMPORTS = """
i AS (SELECT o_orderkey, unnest([{'kind': 'dll', 'token': lower(p_brand) || '.dll'}, {'kind': 'import', 'token': 'imp_' || lower(p_type)}]) AS x
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
im AS (SELECT o_orderkey, x.kind AS kind, x.token AS token FROM i)"""
_SEQUENCES = """
l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS w FROM events GROUP BY user_id),
o0 AS (SELECT user_id, unnest(flatten([[array_to_string(list_slice(w, i, i + n - 1), ' ') FOR i IN generate_series(1, len(w) - n)] FOR n IN [1, 2, 3]])) AS token FROM l),
o AS (SELECT user_id, token, count(*) AS tf FROM o0 GROUP BY ALL),
tdf AS (SELECT token, count(*) AS df FROM o WHERE user_id % 100 < 62 GROUP BY token),
tn AS (SELECT count(*) AS n FROM tdf),
tp AS (SELECT token, df FROM tdf, tn WHERE df > CAST(floor(n * 1.0 / 100) AS BIGINT) AND df < CAST(floor(n - n * 1.0 / 100) AS BIGINT))"""
_GRAM_GAIN = _gain_sql("gg", "SELECT doc_id AS sample, size, gram FROM g SEMI JOIN gp USING (size, gram)", "SELECT doc_id AS sample, family AS y FROM b", "size, gram")
_SEQ_GAIN = _gain_sql("og", "SELECT user_id AS sample, token, tf AS v FROM o", "SELECT DISTINCT user_id AS sample, user_id % 4 AS y FROM events", "token", "v") + """,
odf AS (SELECT token, count(*) AS df FROM o GROUP BY token),
os AS (SELECT token, CASE WHEN df = (SELECT n FROM og_n) - 1 THEN 0.0 ELSE ig END AS ig FROM og JOIN odf USING (token))"""
_ALL_GAINS = f"""WITH {_GRAMS}, {_GRAM_GAIN}, {_SEQUENCES}, {_SEQ_GAIN},
ug AS (SELECT 'byte' AS kind, gram AS token, round(ig, 6) AS ig FROM gg UNION ALL SELECT 'opcode', token, round(ig, 6) FROM os)"""
_BITS = lambda flags: f"array_to_string(list_transform({flags}, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '')"
_TOP = f"top AS (SELECT token FROM sdf ORDER BY df DESC, token LIMIT {PAD_TOP}), vocab AS (SELECT list(token ORDER BY token) AS words FROM top)"
_ENTROPY = """
h0 AS (SELECT doc_id, array_slice(b, i, i) AS x FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b))) AS i FROM b)),
h1 AS (SELECT doc_id, x, count(*) AS c FROM h0 GROUP BY ALL),
ent AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h1 GROUP BY doc_id)"""

ORACLE_SQL = {
    "scan_split": "SELECT doc_id, lang AS family, CASE WHEN doc_id % 100 < 62 THEN 'train' ELSE 'test' END AS split FROM documents",
    "join_features_labels": "SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "union_then_join": "SELECT doc_id, lang AS family, CASE WHEN doc_id % 100 < 62 THEN 'train' ELSE 'test' END AS split, quality FROM documents JOIN labels USING (doc_id)",
    "error_filter": "SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "size_filter": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, round(octet_length(encode(text)) / 1048576.0, 6) AS mb FROM documents WHERE octet_length(encode(text)) <= 2097",
    "strings_extract": f"WITH {_STRINGS} SELECT doc_id, 'str_' || token AS token FROM s",
    "string_docfreq": f"WITH {_STRINGS} SELECT token, df FROM sdf",
    "string_topk": f"""WITH {_STRINGS}, r AS (SELECT token, df, row_number() OVER (ORDER BY df DESC, token) AS k, count(*) OVER () AS v FROM sdf)
SELECT 'str_' || token AS token, df, round(df / (SELECT count(*) FROM documents), 6) AS prevalence FROM r WHERE k <= floor(v * 0.0002)""",
    "byte_entropy": f"WITH b AS (SELECT doc_id, encode(text) AS b FROM documents), {_ENTROPY} SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS \"generic_fileSize\", round(greatest(0.0, coalesce(e, 0.0)), 6) AS \"generic_fileEntropy\" FROM b LEFT JOIN ent USING (doc_id)",
    "ngram_distinct": f"WITH {_GRAMS} SELECT doc_id, size, count(*) AS n, min(gram) AS first_gram, max(gram) AS last_gram FROM g GROUP BY doc_id, size",
    "ngram_docfreq": f"WITH {_GRAMS} SELECT size, df, count(*) AS n_grams FROM gdf GROUP BY size, df",
    "ngram_prevalence": f"WITH {_GRAMS} SELECT size, gram, df FROM gp",
    "ig_ngram": f"WITH {_GRAMS}, {_GRAM_GAIN} SELECT size, gram, round(ig, 6) AS ig FROM gg",
    "import_normalise": """WITH n AS (SELECT p_partkey, lower(p_brand || ['.DLL', '.dll.x', '.drv'][1 + p_partkey % 3]) AS dll, CASE WHEN p_size > 5 THEN 'imp_' || lower(p_type) END AS imp FROM part)
SELECT p_partkey, CASE WHEN ends_with(dll, '.dll') THEN dll ELSE split_part(dll, '.dll', 1) || '.dll' END AS dll, imp FROM n""",
    "import_prevalence": f"""WITH {_IMPORTS}, n AS (SELECT count(*) AS n FROM orders), f AS (SELECT kind, token, count(*) AS df FROM im GROUP BY ALL)
SELECT kind, token, df FROM f, n WHERE df > CAST(floor(n * 12.5 / 100) AS BIGINT) AND df < CAST(floor(n - n * 12.5 / 100) AS BIGINT)""",
    "ig_import": f"WITH {_IMPORTS}, " + _gain_sql("ig", "SELECT DISTINCT o_orderkey AS sample, kind, token FROM im", "SELECT o_orderkey AS sample, o_orderpriority AS y FROM orders", "kind, token") + " SELECT kind, token, round(ig, 6) AS ig FROM ig",
    "opcode_tf": f"WITH {_SEQUENCES} SELECT user_id, 'opcode_' || token AS token, tf FROM o",
    "opcode_docfreq": f"WITH {_SEQUENCES} SELECT token, df FROM tdf",
    "opcode_prevalence": f"WITH {_SEQUENCES} SELECT token, df FROM tp",
    "opcode_docfreq_full": f"WITH {_SEQUENCES} SELECT token, count(*) AS df FROM o SEMI JOIN tp USING (token) GROUP BY token",
    "ig_opcode": f"WITH {_SEQUENCES}, {_SEQ_GAIN} SELECT token, round(ig, 6) AS ig FROM os",
    "tfidf": """WITH c AS (SELECT o_custkey, p_type AS token, count(*) AS tf FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM c GROUP BY token), n AS (SELECT count(DISTINCT o_custkey) AS n FROM c)
SELECT o_custkey, token, tf, df, round(ln(1.0 + tf) * ln(CAST(n AS DOUBLE) / (1.0 + df)), 6) AS weight FROM c JOIN d USING (token), n""",
    "ig_union_dedup": f"{_ALL_GAINS} SELECT kind, token, ig FROM ug QUALIFY row_number() OVER (PARTITION BY kind, token ORDER BY ig DESC) = 1",
    "ig_ccdf": f"{_ALL_GAINS} SELECT kind, token, ig, round(1 - row_number() OVER (ORDER BY ig, kind, token) / count(*) OVER (), 6) AS ccdf FROM ug",
    "ig_elbow": f"{_ALL_GAINS}, r AS (SELECT kind, token, ig, round(1 - row_number() OVER (ORDER BY ig, kind, token) / count(*) OVER (), 6) AS ccdf FROM ug) SELECT * FROM r WHERE ig >= {IG_THRESHOLD} ORDER BY ig, kind, token LIMIT 1",
    "ig_select": f"{_ALL_GAINS} SELECT kind, token, ig FROM ug WHERE ig > {IG_THRESHOLD}",
    "vocab_semi": f"WITH {_STRINGS}, {_TOP} SELECT doc_id, token FROM s SEMI JOIN top USING (token)",
    "pad_presence": f"""WITH {_STRINGS}, {_TOP}, own AS (SELECT doc_id, list(token) AS t FROM s GROUP BY doc_id)
SELECT doc_id, {_BITS("list_transform(words, lambda w: coalesce(list_contains(t, w), false))")} AS features FROM documents LEFT JOIN own USING (doc_id), vocab""",
    "vocab_sizes": f"""WITH {_STRINGS}, {_SEQUENCES}, {_IMPORTS}, u AS (SELECT 'strings' AS kind, token FROM s UNION SELECT 'opcodes', token FROM o UNION SELECT kind, token FROM im)
SELECT kind, count(*) AS n FROM u GROUP BY kind""",
    "subsample": "SELECT doc_id, lang AS family FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 1000",
    "group_stats": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS k FROM lineitem),
w AS (SELECT l_orderkey, l_quantity AS q, 1 AS own FROM e UNION ALL SELECT l_orderkey, l_quantity, 0 FROM e WHERE k = 1),
a AS (SELECT l_orderkey, sum(own) AS n, avg(q) AS m, min(q) AS lo, max(q) AS hi FROM w GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(m, 0.0), 6) AS mean_size, round(coalesce(lo, 0.0), 6) AS min_size, round(coalesce(hi, 0.0), 6) AS max_size FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""",
    "bit_explode": "SELECT p_partkey, " + ", ".join(f"(p_size >> {k}) & 1 = 1 AS characteristics_bit{k}" for k in range(16)) + " FROM part",
    "std_flags": f"WITH n AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand ELSE 'none' END AS name FROM part) SELECT p_partkey, name <> 'none' AS name_exists, name IN {STANDARD_BRANDS} AS name_isstandard FROM n",
    "flagship": f"""WITH {_GRAMS}, {_GRAM_GAIN}, {_STRINGS}, {_TOP}, {_ENTROPY},
gt AS (SELECT gram FROM gg WHERE size = 4 ORDER BY round(ig, 6) DESC, gram LIMIT {PAD_TOP}), gv AS (SELECT list(gram ORDER BY gram) AS grams FROM gt),
own AS (SELECT doc_id, list(token) AS t FROM s SEMI JOIN top USING (token) GROUP BY doc_id), og AS (SELECT doc_id, list(gram) AS t4 FROM (SELECT doc_id, gram FROM g SEMI JOIN gt USING (gram) WHERE size = 4) GROUP BY doc_id)
SELECT doc_id, family, CAST(octet_length(b) AS BIGINT) AS generic_filesize, round(greatest(0.0, coalesce(e, 0.0)), 6) AS generic_fileentropy,
  {_BITS("list_transform(words, lambda w: coalesce(list_contains(t, w), false))")} AS strings, {_BITS("list_transform(grams, lambda w: coalesce(list_contains(t4, w), false))")} AS grams
FROM b LEFT JOIN ent USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN og USING (doc_id), vocab, gv""",
}
