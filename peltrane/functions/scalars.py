"""Scalar functions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEGABYTE = 1024 * 1024
#: Names of the nine standard sections, fixed values; case counts.
STANDARD_SECTIONS = (".text", ".data", ".rdata", ".idata", ".edata", ".rsrc", ".bss", ".crt", ".tls")


def strip(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")


def dll_name(name: Column) -> Column:
    """Lower case; what doesn't end in .dll is cut at the first .dll and given that ending."""
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".dll")), low).otherwise(F.concat(F.substring_index(low, ".dll", 1), F.lit(".dll")))


def import_name(name: Column) -> Column:
    return F.concat(F.lit("imp_"), F.lower(name))


def bit(value: Column, k: int) -> Column:
    """Bit k, the lowest being 0."""
    return F.shiftright(value.cast("long"), k).bitwiseAND(F.lit(1).cast("long")) == 1


def tf(count: Column) -> Column:
    return F.ln(1.0 + count)


def idf(df: Column, n: Column) -> Column:
    """May be zero or negative."""
    return F.ln(n.cast("double") / (1.0 + df))


def megabytes(length: Column) -> Column:
    return length / F.lit(float(MEGABYTE))


def is_standard_section(name: Column) -> Column:
    return F.coalesce(name.isin(*STANDARD_SECTIONS), F.lit(False))


def section_exists(name: Column) -> Column:
    return F.coalesce(name, F.lit("none")) != "none"
