"""Features of parsed PE files: headers, sections, resources, imports; all native expressions on the parsed column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.pe import OPTIONAL_FIELDS
from .groups import part_stats

SLOTS = 16
BITS = 32
I386 = 332
#: Section fields in the order of a slot: name, kind, field of the parsed section. Fixed values.
FIELDS = (
    ("name", "object", "name"),
    ("size", "int64", "size"),
    ("virtualSize", "int64", "virtualSize"),
    ("virtualAddress", "int64", "virtualAddress"),
    ("physicalAddress", "int64", "physicalAddress"),
    ("entropy", "float64", "entropy"),
    ("rawAddress(pointerToRawData)", "int64", "rawPointer"),
    ("pointerToRelocations", "int64", "pointerToRelocations"),
    ("numberOfRelocations", "int64", "numberOfRelocations"),
)
DEFAULTS = {"object": ("none", "string"), "int64": (0, "bigint"), "float64": (0.0, "double"), "bool": (False, "boolean")}


def section_schema() -> list[tuple[str, str]]:
    """All section features and their kinds: the entry point's section, aggregates, and the slots."""
    bits = [(f"characteristics_bit{k}", "bool") for k in range(BITS)]
    out = [(f"pesectionProcessed_entrypointSection_{n}", k) for n, k in bits + sorted((n, k) for n, k, _ in FIELDS)]
    for part in ("resources", "sections"):
        for s in ("Max", "Mean", "Min"):
            for what in ("Entropy", "Size", *["VirtualSize"] * (part == "sections")):
                out.append((f"pesectionProcessed_{part}{s}{what}", "float64" if what == "Entropy" or s == "Mean" else "int64"))
        if part == "resources":
            out.append(("pesectionProcessed_resources_nb", "int64"))
    for slot in range(1, SLOTS + 1):
        out += [(f"pesection_{slot}_{n}", k) for n, k in bits + [(n, k) for n, k, _ in FIELDS]]
    return out


def header_features(pe: Column) -> list[Column]:
    """29 columns; a field that a file's format lacks is 0."""
    zero = F.lit(0).cast("bigint")
    out = [F.coalesce(pe[n], zero).alias(f"header_{n}") for n, *_ in OPTIONAL_FIELDS]
    out += [pe[n].alias(f"header_{n}") for n in ("NumberOfSections", "SizeOfOptionalHeader")]
    return out + [scalars.bit(pe["characteristics"], k).alias(f"header_characteristics_bit{k}") for k in range(16)]


def entry_section(pe: Column) -> Column:
    """The last section whose addresses hold the entry point; null if none does."""
    at = pe["AddressOfEntryPoint"]
    held = F.filter(pe["sections"], lambda s: (at >= s["virtualAddress"]) & (at - s["virtualAddress"] < s["virtualSize"]))
    return F.try_element_at(held, F.lit(-1))


def _padded(value: Column, kind: str) -> Column:
    default, cast = DEFAULTS[kind]
    return F.coalesce(value.cast(cast), F.lit(default).cast(cast))


def _part(section: Column, name: str, kind: str) -> Column:
    if name.startswith("characteristics_bit"):
        return _padded(scalars.bit(section["characteristics"], int(name.removeprefix("characteristics_bit"))), kind)
    return _padded(section[next(f for n, _, f in FIELDS if n == name)], kind)


def section_error(pe: Column) -> Column:
    """Why a file has no section features."""
    return F.coalesce(pe["error"], F.when(entry_section(pe).isNull(), F.lit("no section holds the entry point")))


def section_features(files: DataFrame, pe: str = "pe", prefix: str = "") -> DataFrame:
    """files with the 713 section features (those of a prefix), padded, and section_error. Files with an error have padding alone."""
    p = F.col(pe)
    f = files.withColumn("section_error", section_error(p)).withColumn("_entry", entry_section(p))
    none = F.array().cast("array<double>")
    for what, field in (("Entropy", "entropy"), ("Size", "size"), ("VirtualSize", "virtualSize")):
        values = F.transform(F.col(f"{pe}.sections"), _picker(field))
        again = F.when(F.col("_entry").isNull(), none).otherwise(F.array(F.col(f"_entry.{field}").cast("double")))
        f = f.withColumn(f"_sections{what}", part_stats(F.coalesce(values, none), again))
    for what, field in (("Entropy", "entropy"), ("Size", "size")):
        f = f.withColumn(f"_resources{what}", part_stats(F.coalesce(F.transform(F.col(f"{pe}.resources"), _picker(field)), none)))
    good = F.col("section_error").isNull()
    out = []
    for name, kind in section_schema():
        if not name.startswith(prefix):
            continue
        if name.startswith("pesectionProcessed_entrypointSection_"):
            value = _part(F.col("_entry"), name.removeprefix("pesectionProcessed_entrypointSection_"), kind)
        elif name == "pesectionProcessed_resources_nb":
            value = F.size(F.coalesce(F.col(f"{pe}.resources"), F.array().cast("array<struct<size:bigint,entropy:double>>")))
        elif name.startswith("pesectionProcessed_"):
            part, s, what = re.fullmatch("pesectionProcessed_(resources|sections)(Max|Mean|Min)(.*)", name).groups()
            value = F.col(f"_{part}{what}.{s.lower()}")
        else:
            slot, field = name.removeprefix("pesection_").split("_", 1)
            value = _part(F.get(F.col(f"{pe}.sections"), int(slot) - 1), field, kind)
        out.append(F.when(good, _padded(value, kind)).otherwise(_padded(F.lit(None), kind)).alias(name))
    own = [F.col(f"`{c}`") for c in files.columns]
    return f.select(*own, "section_error", *out)


def _picker(field: str):
    return lambda s: s[field].cast("double")


def enriched(features: DataFrame) -> DataFrame:
    """With `exists` and `isStandard` for each slot's name, and without the names."""
    more = []
    for slot in range(1, SLOTS + 1):
        name = F.col(f"pesection_{slot}_name")
        more += [scalars.section_exists(name).alias(f"pesection_{slot}_exists"), scalars.is_standard_section(name).alias(f"pesection_{slot}_isStandard")]
    return features.select("*", *more).drop(*[f"pesection_{slot}_name" for slot in range(1, SLOTS + 1)])


def section_count(pe: Column) -> Column:
    """The number of sections of an I386 file, -1 for others."""
    return F.when(pe["machine"] == I386, F.size(pe["sections"])).otherwise(F.lit(-1))


def import_lists(pe: Column) -> Column:
    """(dlls, imps, error): normalised, in order, repeats kept; empty after an error."""
    listed = F.coalesce(pe["imports"], F.array().cast("array<struct<dll:string,names:array<string>>>"))
    names = F.filter(F.flatten(F.transform(listed, lambda e: e["names"])), lambda n: n.isNotNull() & (n != ""))
    return F.struct(
        F.transform(listed, lambda e: scalars.dll_name(e["dll"])).alias("dlls"),
        F.transform(names, scalars.import_name).alias("imps"),
        F.coalesce(pe["error"], pe["imports_error"]).alias("error"),
    )


def import_tokens(files: DataFrame, *, sample: str, pe: str = "pe") -> DataFrame:
    """(sample, kind, token), repeats kept; kinds dll and import."""
    x = files.select(sample, import_lists(F.col(pe)).alias("x"))
    both = F.concat(F.transform("x.dlls", lambda d: F.struct(F.lit("dll").alias("kind"), d.alias("token"))), F.transform("x.imps", lambda d: F.struct(F.lit("import").alias("kind"), d.alias("token"))))
    return x.select(sample, F.explode(both).alias("t")).select(sample, "t.kind", "t.token")
