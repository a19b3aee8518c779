"""Registered queries over program files: each customer is a PE file written from its orders, then parsed again.

What a file holds is arithmetic on keys, so SQL can say what the parser and the features must give without reading a file.
Files are written by the package's own writer and parsed by its parser; every eleventh is no PE file, some have no section
at their entry point, some an unsupported machine type.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, sql, tokens
from ..operators import padding, pe_features, vocabulary
from ..sources import disassembly, pe, samples
from ..sources.pe_writer import build
from ..sources.shared import shared_dir
from . import catalogue
from .config import Config
from .pipeline import Pipeline

NAMES = (b".text", b".data", b"\xff\xfe", b"UPX", b".CRT")  # section names by order key; the third is no UTF-8
ENDINGS = (".DLL", ".dll.x", ".drv")
PAD_WEIGHTS, IMPORT_PERCENT = 8, 1.0
FIELD = 1 << 32  # header fields of 32 bits hold less than this


def _pattern(size: int, bits: int) -> bytes:
    """Bytes of an entropy of just that many bits."""
    return bytes(range(1 << bits)) * (size >> bits)


def sectioned_file(c: int, orders: list[int]) -> bytes:
    """A section for each order; the entry point in one of them, or in none. Header fields of 32 bits have the low bits of large keys."""
    if c % 11 == 0:
        return b"MZ" + bytes(c % 200)
    name = lambda o: NAMES[o % 5] + (b"%d" % (o % 10) if o % 5 == 3 else b"")
    sections = [(name(o), _pattern(512 * (1 + o % 3), o % 9), 4096 * (k + 1), 100 + o % 1000, o * 2654435761 % (1 << 32)) for k, o in enumerate(orders)]
    e, plus = c % (len(orders) + 1), c % 2 == 1
    machine = 0x1C0 if c % 7 == 0 else disassembly.AMD64 if plus else disassembly.I386
    entry = 4096 * (e + 1) + c % 100 if e < len(orders) else 0x90
    base = 0x140000000 + 65536 * c if plus else (0x400000 + 65536 * c) % FIELD
    return build(sections, plus=plus, machine=machine, entry=entry, flags=c % 65536, base=base, opt={"code": 512 * len(orders), "data": c % FIELD, "bss": 7})


def importing_file(c: int, orders: list[int]) -> bytes:
    """A library for each order, with two names, one name and an ordinal, or nothing imported from it; and a resource."""
    if c % 11 == 0:
        return b"MZ" + bytes(c % 200)
    names = lambda o: [] if o % 6 == 5 else [f"Call{o % 8}", None if o % 4 == 0 else f"Get{o % 50}"]
    listed = [(f"Lib{o % 13}{ENDINGS[o % 3]}", names(o)) for o in orders]
    return build(plus=c % 2 == 1, imports=listed, resources=[_pattern(16 * (1 + o % 5), o % 4) for o in orders])


def files(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """(c, content): a file for each customer."""
    orders = catalogue._table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))  # some ten each
    customers = catalogue._table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    rows = customers.join(orders, F.col("c") == F.col("o_custkey"), "left").select("c", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"))

    def content(c: pd.Series, orders: pd.Series) -> pd.Series:
        return pd.Series([make(int(k), [int(x) for x in o]) for k, o in zip(c, orders, strict=True)])

    return rows.select("c", F.pandas_udf(content, "binary")("c", "orders").alias("content"))


def _parsed(spark, sf_dir, make) -> DataFrame:
    return files(spark, sf_dir, make).withColumn("pe", pe.parse_pe(F.col("content")))


def pe_headers(spark, sf_dir):
    """All header features, and the section count of I386 files."""
    p = F.col("pe")
    out = _parsed(spark, sf_dir, sectioned_file).select("c", p["error"].alias("error"), *pe_features.header_features(p), pe_features.section_count(p).cast("long").alias("n_sections"))
    c, good = F.col("c").cast("bigint"), F.col("error").isNull()
    above = lambda v: v - v % F.lit(FIELD)  # noqa: E731  what a field of 32 bits can't hold of a number
    out = out.withColumn("header_ImageBase", F.col("header_ImageBase") + F.when(good & (c % 2 == 0), above(0x400000 + 65536 * c)).otherwise(0))
    out = out.withColumn("header_SizeOfInitializedData", F.col("header_SizeOfInitializedData") + F.when(good, above(c)).otherwise(0))
    return out.fillna(0).fillna(False, [c for c in out.columns if "_bit" in c])


def pe_sections(spark, sf_dir):
    """All section features after enrichment: entry point, aggregates, slots, flags."""
    out = pe_features.enriched(pe_features.section_features(_parsed(spark, sf_dir, sectioned_file).select("c", "pe")))
    kinds = dict(out.dtypes)
    return out.select("c", "section_error", *[(F.round(F.col(f"`{c}`"), 6) if kinds[c] == "double" else F.col(f"`{c}`")).alias(c) for c in out.columns if c.startswith("pesection")])


def pe_imports(spark, sf_dir):
    """Imported libraries and functions, normalised, with their number in a file."""
    found = pe_features.import_tokens(_parsed(spark, sf_dir, importing_file), sample="c")
    return found.groupBy("c", "kind", "token").agg(F.count(F.lit(1)).alias("n"))


def pe_resources(spark, sf_dir):
    """Resource aggregates, the file parsed by the function for SQL text."""
    sql.register(spark, byte_decoder)
    files(spark, sf_dir, importing_file).createOrReplaceTempView(view := f"files_{uuid.uuid4().hex}")
    out = pe_features.section_features(spark.sql(f"SELECT c, parse_pe(content) AS pe FROM {view}"), prefix="pesectionProcessed_resources")
    parts = [c for c in out.columns if c.startswith("pesectionProcessed_resources")]
    return out.select("c", *[F.round(F.col(c), 6).alias(c.removeprefix("pesectionProcessed_")) for c in parts])


def byte_decoder(machine: int, code: bytes, address: int) -> list[str]:
    """Stands in for a disassembler: each of the first twenty bytes is an instruction."""
    return [f"i{b}" for b in code[:20]]


def pe_opcodes(spark, sf_dir):
    """Instruction n-grams of the section at the entry point; files with an error have none."""
    ops = _parsed(spark, sf_dir, sectioned_file).select("c", disassembly.disassemble(F.col("pe"), byte_decoder).alias("ops"))
    return tokens.sequence_ngrams(ops.where(F.col("ops.error").isNull()).select("c", "ops.items"), sample="c", items="items")


def pe_opcode_errors(spark, sf_dir):
    """Why files have no instructions."""
    ops = _parsed(spark, sf_dir, sectioned_file).select("c", disassembly.disassemble(F.col("pe"), byte_decoder).alias("ops"))
    return ops.where(F.col("ops.error").isNotNull()).select("c", F.col("ops.error").alias("error"))


def pe_dataset(spark, sf_dir):
    """The pipeline from files and a split to the dataset: selection on train, one padded row per file of train and test."""
    made = files(spark, sf_dir, importing_file).select(F.format_string("%064x", "c").alias("sha256"), F.lit("f").alias("family"), F.octet_length("content").cast("long").alias("length"), "content")
    split = catalogue._table(spark, sf_dir, "customer").select(F.format_string("%064x", "c_custkey").alias("sha256"), catalogue._split(F.col("c_custkey")).alias("split"))
    config = Config(files="", split="", import_percent=IMPORT_PERCENT, sample_files=100)
    out = Pipeline(spark, config, f"{shared_dir(spark)}/experiment-{uuid.uuid4().hex}", decoder=byte_decoder, files=made, split=split).run()
    bits = [padding.bits_text(F.col(k)).alias(k) for k in ("dlls", "imports")]
    return out.select("sha256", F.coalesce("header_NumberOfSections", F.lit(0).cast("long")).alias("header_NumberOfSections"), F.col("pesectionProcessed_resources_nb").alias("n_resources"), *bits, F.array_contains(F.lit(list(out.columns)), "ngrams").alias("has_ngrams"))


def pad_weights(spark, sf_dir):
    """TF-IDF weights of a customer's parts on the most frequent part types."""
    w = catalogue.tfidf(spark, sf_dir).select("o_custkey", "token", "df", "weight")
    words = [r["token"] for r in vocabulary.top_k(w.select("token", "df").distinct(), PAD_WEIGHTS).collect()]  # PAD_WEIGHTS rows
    customers = catalogue._table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = padding.pad_weights(customers, w, words, sample="o_custkey")
    return out.select("o_custkey", *[F.coalesce(F.get("weights", F.lit(k)), F.lit(0.0)).alias(f"w{k}") for k in range(PAD_WEIGHTS)])


QUERIES = {f.__name__: f for f in (pe_headers, pe_sections, pe_imports, pe_resources, pe_opcodes, pe_opcode_errors, pe_dataset, pad_weights)}

# -- The same in SQL -------------------------------------------------------------------------------------------------

_FILES = """
o AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
s AS (SELECT c, k, o, CASE o % 5 WHEN 0 THEN '.text' WHEN 1 THEN '.data' WHEN 2 THEN 'b' || chr(39) || '\\xff\\xfe\\x00\\x00\\x00\\x00\\x00\\x00' || chr(39) WHEN 3 THEN 'UPX' || (o % 10) ELSE '.CRT' END AS name,
  512 * (1 + o % 3) AS size, 100 + o % 1000 AS vsize, 4096 * (k + 1) AS va, CAST(o % 9 AS DOUBLE) AS entropy, o * 2654435761 % 4294967296 AS flags,
  CAST(sum(512 * (1 + o % 3)) OVER (PARTITION BY c ORDER BY k) AS BIGINT) - 512 * (1 + o % 3) AS before FROM o),
l AS (SELECT c, count(*) AS n, list({'name': name, 'size': size, 'vsize': vsize, 'va': va, 'entropy': entropy, 'flags': flags, 'before': before, 'o': o} ORDER BY k) AS l, max(va + greatest(size, vsize)) AS last FROM s GROUP BY c),
f AS (SELECT c_custkey AS c, c_custkey % 2 AS plus, coalesce(n, 0) AS n, coalesce(last, 4096) AS last, l, c_custkey % (coalesce(n, 0) + 1) AS e,
  CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN 2 + c_custkey % 200 < 64 THEN 'no DOS header' ELSE 'no PE signature' END END AS error,
  224 + 16 * (c_custkey % 2) AS opt FROM customer LEFT JOIN l ON c = c_custkey),
h AS (SELECT *, CAST(ceil((88 + opt + 40 * n) / 512.0) AS BIGINT) * 512 AS headers, coalesce(error, CASE WHEN e = n THEN 'no section holds the entry point' END) AS section_error FROM f),
g AS (SELECT * EXCLUDE (l), CASE WHEN section_error IS NULL THEN l END AS l, CASE WHEN section_error IS NULL THEN l[e + 1] END AS en FROM h)"""


def _headers_sql() -> str:
    value = {
        "SizeOfHeaders": "headers", "AddressOfEntryPoint": "CASE WHEN e < n THEN 4096 * (e + 1) + c % 100 ELSE 144 END", "ImageBase": "CASE plus WHEN 1 THEN 5368709120 ELSE 4194304 END + 65536 * c",
        "SizeOfImage": "CAST(ceil(last / 4096.0) AS BIGINT) * 4096", "SizeOfCode": "512 * n", "SizeOfInitializedData": "c", "SizeOfUninitializedData": "7", "BaseOfCode": "4096",
        "BaseOfData": "CASE plus WHEN 1 THEN 0 ELSE 8192 END", "SectionAlignment": "4096", "FileAlignment": "512",
    }
    out = [f'CASE WHEN error IS NULL THEN {v} ELSE 0 END AS "header_{k}"' for k, v in value.items()]
    out += [f'CASE WHEN error IS NULL THEN {v} ELSE 0 END AS "header_{k}"' for k, v in (("NumberOfSections", "n"), ("SizeOfOptionalHeader", "opt"))]
    out += [f"CASE WHEN error IS NULL THEN (c >> {k}) & 1 = 1 ELSE false END AS header_characteristics_bit{k}" for k in range(16)]
    return f"WITH {_FILES} SELECT c, error, {', '.join(out)}, CASE WHEN error IS NULL AND plus = 0 AND c % 7 <> 0 THEN n ELSE -1 END AS n_sections FROM h"


def _sections_sql() -> str:
    field = {"name": "name", "size": "size", "virtualSize": "vsize", "virtualAddress": "va", "physicalAddress": "vsize", "entropy": "entropy"}
    bit = lambda x, k: f"coalesce(({x}.flags >> {k}) & 1 = 1, false)"

    def one(x: str, name: str) -> str:
        if name.startswith("characteristics_bit"):
            return bit(x, int(name.removeprefix("characteristics_bit")))
        if name == "rawAddress(pointerToRawData)":
            return f"coalesce(headers + {x}.before, 0)"
        if name in ("pointerToRelocations", "numberOfRelocations"):
            return f"CASE WHEN {x} IS NULL THEN 0 ELSE {7 if name.startswith('pointer') else 3} END"
        return f"coalesce({x}.{field[name]}, " + {"name": "'none'", "entropy": "0.0"}.get(name, "0") + ")"

    out = []
    for name, _ in pe_features.section_schema():
        if name.startswith("pesectionProcessed_entrypointSection_"):
            value = one("en", name.removeprefix("pesectionProcessed_entrypointSection_"))
        elif name.startswith("pesectionProcessed_resources"):
            value = "0" if name.endswith("_nb") or name.endswith(("MaxSize", "MinSize")) else "0.0"
        elif name.startswith("pesectionProcessed_sections"):
            rest = name.removeprefix("pesectionProcessed_sections")
            what = {"Entropy": "entropy", "Size": "size", "VirtualSize": "vsize"}[rest[3:].removeprefix("n") if rest.startswith("Mean") else rest[3:]]
            values = f"list_append(list_transform(l, lambda x: x.{what}), en.{what})"
            value = {"Max": f"coalesce(list_max({values}), 0)", "Min": f"coalesce(list_min({values}), 0)", "Mea": f"round(coalesce(list_avg({values}), 0.0), 6)"}[rest[:3]]
        else:
            slot, part = name.removeprefix("pesection_").split("_", 1)
            if part == "name":
                continue
            value = one(f"l[{slot}]", part)
        out.append(f'{value} AS "{name}"')
    for slot in range(1, pe_features.SLOTS + 1):
        out.append(f"coalesce(l[{slot}].name, 'none') <> 'none' AS \"pesection_{slot}_exists\"")
        out.append(f"coalesce(l[{slot}].name, 'none') IN {scalars.STANDARD_SECTIONS} AS \"pesection_{slot}_isStandard\"")
    return f"WITH {_FILES} SELECT c, section_error, {', '.join(out)} FROM g"


_IMPORTS = """
i AS (SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 11 <> 0),
t AS (SELECT c, 'dll' AS kind, 'lib' || (o % 13) || CASE o % 3 WHEN 2 THEN '.drv.dll' ELSE '.dll' END AS token FROM i
  UNION ALL SELECT c, 'import', 'imp_call' || (o % 8) FROM i WHERE o % 6 <> 5 UNION ALL SELECT c, 'import', 'imp_get' || (o % 50) FROM i WHERE o % 6 <> 5 AND o % 4 <> 0)"""
_RESOURCES = ", ".join(
    f"CAST(coalesce({f}({v}), 0) AS {kind}) AS \"resources{name}{what}\"" if f != "avg" else f"round(coalesce(avg({v}), 0.0), 6) AS \"resources{name}{what}\""
    for name, f in (("Max", "max"), ("Mean", "avg"), ("Min", "min"))
    for what, v, kind in (("Entropy", "o % 4", "DOUBLE"), ("Size", "16 * (1 + o % 5)", "BIGINT"))
)
_INSTRUCTIONS = f"""{_FILES},
d AS (SELECT c, [CAST('i' || (j % (1 << CAST(en.o % 9 AS INT))) AS VARCHAR) FOR j IN range(20)] AS w FROM g WHERE section_error IS NULL AND c % 7 <> 0),
u AS (SELECT c, unnest(flatten([[array_to_string(list_slice(w, i, i + n - 1), ' ') FOR i IN generate_series(1, len(w) - n)] FOR n IN [1, 2, 3]])) AS token FROM d)"""
_BITS = "list_aggregate(list_transform({}, lambda w: CASE WHEN list_contains(coalesce({}, []), w) THEN '1' ELSE '0' END), 'string_agg', '')"

ORACLE_SQL = {
    "pe_headers": _headers_sql(),
    "pe_sections": _sections_sql(),
    "pe_imports": f"WITH {_IMPORTS} SELECT c, kind, token, count(*) AS n FROM t GROUP BY ALL",
    "pe_resources": f"SELECT c_custkey AS c, {_RESOURCES}, count(o) AS resources_nb FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS o FROM orders WHERE o_custkey % 11 <> 0) ON o_custkey = c_custkey GROUP BY c_custkey",
    "pe_opcodes": f"WITH {_INSTRUCTIONS} SELECT c, token, count(*) AS tf FROM u GROUP BY ALL",
    "pe_opcode_errors": f"WITH {_FILES} SELECT c, CASE WHEN section_error IS NOT NULL THEN section_error ELSE 'unsupported machine type 0x1c0' END AS error FROM g WHERE section_error IS NOT NULL OR c % 7 = 0",
    "pe_dataset": f"""WITH {_IMPORTS},
n AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 100 < 62),
df AS (SELECT kind, token, count(*) AS df FROM t WHERE c % 100 < 62 GROUP BY ALL),
v AS (SELECT kind, list(token ORDER BY token) AS words FROM df, n WHERE df > CAST(floor(n * {IMPORT_PERCENT} / 100) AS BIGINT) AND df < CAST(floor(n - n * {IMPORT_PERCENT} / 100) AS BIGINT) GROUP BY kind),
own AS (SELECT c, list(DISTINCT token) FILTER (WHERE kind = 'dll') AS d, list(DISTINCT token) FILTER (WHERE kind = 'import') AS i FROM t GROUP BY c),
r AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY ALL)
SELECT printf('%064x', c_custkey) AS sha256, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN n > 0 THEN 3 ELSE 1 END ELSE 0 END AS "header_NumberOfSections", CASE WHEN c_custkey % 11 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_resources,
  {_BITS.format("(SELECT words FROM v WHERE kind = 'dll')", "d")} AS dlls, {_BITS.format("(SELECT words FROM v WHERE kind = 'import')", "i")} AS imports, false AS has_ngrams
FROM customer LEFT JOIN own ON own.c = c_custkey LEFT JOIN r ON r.c = c_custkey""",
    "pad_weights": f"""WITH {catalogue.ORACLE_SQL["tfidf"].removeprefix("WITH ").rsplit("SELECT o_custkey, token, tf, df", 1)[0]},
w AS (SELECT o_custkey, token, df, round(ln(1.0 + tf) * ln(CAST(n AS DOUBLE) / (1.0 + df)), 6) AS weight FROM c JOIN d USING (token), n),
v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS k FROM (SELECT token FROM d ORDER BY df DESC, token LIMIT {PAD_WEIGHTS}))
SELECT c_custkey AS o_custkey, {", ".join(f"coalesce(max(weight) FILTER (WHERE k = {k}), min(weight) FILTER (WHERE k = {k}), 0.0) AS w{k}" for k in range(PAD_WEIGHTS))}
FROM customer LEFT JOIN (w JOIN v USING (token)) ON o_custkey = c_custkey GROUP BY c_custkey""",
}
