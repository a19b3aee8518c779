"""Mnemonics of code bytes. The decoder is pluggable; without one a row gets an error and never an invented mnemonic."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: COFF machine types, fixed values.
I386, AMD64, ARM64, POWERPC, UNKNOWN = 0x14C, 0x8664, 0xAA64, 0x1F0, 0
RESULT = "struct<items:array<string>,error:string>"
Decoder = Callable[[int, bytes, int], list[str]]


def capstone_decoder(machine: int, code: bytes, address: int) -> list[str]:
    """Decodes up to the first bytes that are no instruction. Needs the capstone package."""
    import capstone

    modes = {
        I386: (capstone.CS_ARCH_X86, capstone.CS_MODE_32),
        AMD64: (capstone.CS_ARCH_X86, capstone.CS_MODE_64),
        ARM64: (capstone.CS_ARCH_ARM64, capstone.CS_MODE_ARM),
        POWERPC: (capstone.CS_ARCH_PPC, capstone.CS_MODE_32),
    }
    return [mnemonic for _, _, mnemonic, _ in capstone.Cs(*modes[machine]).disasm_lite(code, address)]


def decoded(machine: int | None, code: bytes | None, address: int | None, error: str | None, decoder: Decoder) -> dict:
    if error or code is None:
        return {"items": None, "error": error or "no code"}
    if machine == UNKNOWN:
        return {"items": None, "error": "unknown machine type"}
    if machine not in (I386, AMD64, ARM64, POWERPC):
        return {"items": None, "error": f"unsupported machine type {machine:#x}"}
    try:
        return {"items": decoder(machine, code, address or 0), "error": None}
    except ImportError:
        return {"items": None, "error": "no disassembler"}
    except Exception as e:  # a decoder's own failure stays with its row
        return {"items": None, "error": f"{type(e).__name__}: {e}"}


def disassemble_function(decoder: Decoder = capstone_decoder):
    """(machine, code, address, error) to (items, error), as an Arrow UDF."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(RESULT))

    def run(machine: pa.Array, code: pa.Array, address: pa.Array, error: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (machine, code, address, error)), strict=True)
        return pa.array([decoded(*r, decoder) for r in rows], type=kind)

    return F.arrow_udf(run, RESULT)


def disassemble(pe: Column, decoder: Decoder = capstone_decoder) -> Column:
    """(items, error) of a parsed file."""
    return disassemble_function(decoder)(pe["machine"], pe["code"], pe["code_address"], pe["code_error"])
