"""PE files: parsed once, in plain Python, into one nested column.

Written from the public PE/COFF layout. Rounding of raw pointers and the search for the section of an address follow
the loader's habits that common parsers share: raw pointers are rounded down to 512 bytes if the file alignment is at least that,
a section ends where the next one begins, and what lies in no section is read from the headers.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of the optional header: name, place in PE32, in PE32+ (None: not there), formats. Fixed values.
OPTIONAL_FIELDS = (
    ("SizeOfHeaders", 60, 60, "I", "I"),
    ("AddressOfEntryPoint", 16, 16, "I", "I"),
    ("ImageBase", 28, 24, "I", "Q"),
    ("SizeOfImage", 56, 56, "I", "I"),
    ("SizeOfCode", 4, 4, "I", "I"),
    ("SizeOfInitializedData", 8, 8, "I", "I"),
    ("SizeOfUninitializedData", 12, 12, "I", "I"),
    ("BaseOfCode", 20, 20, "I", "I"),
    ("BaseOfData", 24, None, "I", ""),
    ("SectionAlignment", 32, 32, "I", "I"),
    ("FileAlignment", 36, 36, "I", "I"),
)
SECTION_TYPE = "struct<name:string,characteristics:bigint,size:bigint,virtualSize:bigint,virtualAddress:bigint,physicalAddress:bigint,entropy:double,rawPointer:bigint,pointerToRelocations:bigint,numberOfRelocations:bigint>"
PE_TYPE = (
    "struct<error:string,machine:int,NumberOfSections:bigint,SizeOfOptionalHeader:bigint,characteristics:bigint,"
    + ",".join(f"{n}:bigint" for n, *_ in OPTIONAL_FIELDS)
    + f",sections:array<{SECTION_TYPE}>,imports:array<struct<dll:string,names:array<string>>>,imports_error:string,"
    "resources:array<struct<size:bigint,entropy:double>>,resources_error:string,code:binary,code_address:bigint,code_error:string>"
)


class PEError(ValueError):
    """What makes a file no PE file."""


def entropy(data: bytes) -> float:
    if not data:
        return 0.0
    c = np.bincount(np.frombuffer(data, dtype=np.uint8))
    p = c[c > 0] / len(data)
    return max(0.0, float(-(p * np.log2(p)).sum()))


class Image:
    """The headers and sections of a file, and its bytes by address."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 64 or data[:2] != b"MZ":
            raise PEError("no DOS header")
        at = self._number(60, "I")
        if data[at : at + 4] != b"PE\0\0":
            raise PEError("no PE signature")
        self.machine, self.n_sections, _, _, _, self.optional_size, self.characteristics = self._numbers(at + 4, "HHIIIHH")
        optional = at + 24
        magic = self._number(optional, "H")
        if magic not in (0x10B, 0x20B):
            raise PEError("no optional header")
        self.plus = magic == 0x20B
        self.optional = {}
        for name, narrow, wide, narrow_kind, wide_kind in OPTIONAL_FIELDS:
            place, kind = (wide, wide_kind) if self.plus else (narrow, narrow_kind)
            self.optional[name] = 0 if place is None else self._number(optional + place, kind)
        directories = optional + (112 if self.plus else 96)
        count = min(16, self._number(directories - 4, "I"))
        self.directories = [self._numbers(directories + 8 * k, "II") for k in range(count) if directories + 8 * k + 8 <= len(data)]
        self.sections = []
        first = optional + self.optional_size
        for k in range(self.n_sections):
            if first + 40 * k + 40 > len(data):
                break
            name, vsize, va, size, raw, reloc, _, n_reloc, _, flags = self._numbers(first + 40 * k, "8sIIIIIIHHI")
            self.sections.append({"name": name, "virtualSize": vsize, "virtualAddress": va, "size": size, "rawPointer": raw, "pointerToRelocations": reloc, "numberOfRelocations": n_reloc, "characteristics": flags})

    def _numbers(self, at: int, kinds: str) -> tuple:
        try:
            return struct.unpack_from("<" + kinds, self.data, at)
        except struct.error:
            raise PEError(f"cut off at {at}") from None

    def _number(self, at: int, kind: str) -> int:
        return self._numbers(at, kind)[0]

    def raw_start(self, section: dict) -> int:
        pointer = section["rawPointer"]
        return pointer if self.optional["FileAlignment"] < 512 else pointer - pointer % 512

    def mapped_start(self, section: dict) -> int:
        unit = self.optional["SectionAlignment"]
        if unit < 4096:
            unit = self.optional["FileAlignment"]
        address = section["virtualAddress"]
        return address - address % unit if unit else address

    def content(self, section: dict) -> bytes:
        return self.data[self.raw_start(section) : section["rawPointer"] + section["size"]]

    def section_of(self, address: int) -> dict | None:
        """The first section that holds an address, after rounding."""
        later = sorted({s["virtualAddress"] for s in self.sections})
        for s in self.sections:
            start = self.mapped_start(s)
            short = len(self.data) - self.raw_start(s) < s["size"]
            end = start + (s["virtualSize"] if short else max(s["size"], s["virtualSize"]))
            following = next((x for x in later if x > s["virtualAddress"]), None)
            if following is not None:
                end = min(end, following)
            if start <= address < end:
                return s
        return None

    def at(self, address: int, size: int) -> bytes:
        """Up to size bytes at a relative address."""
        s = self.section_of(address)
        if s is None:
            return self.data[address : address + size]
        return self.content(s)[address - self.mapped_start(s) :][:size]

    def text_at(self, address: int) -> bytes:
        return self.at(address, 1024).split(b"\0", 1)[0]

    def imports(self) -> list[dict]:
        """Libraries with the names imported from them, in order; imports by ordinal have no name."""
        out = []
        if len(self.directories) < 2 or not self.directories[1][0]:
            return out
        address, width = self.directories[1][0], 8 if self.plus else 4
        while len(entry := self.at(address, 20)) == 20:
            lookup, _, _, name, table = struct.unpack("<IIIII", entry)
            if not name and not table:
                break
            names, thunk = [], lookup or table
            while len(cell := self.at(thunk, width)) == width and (value := int.from_bytes(cell, "little")):
                if not value >> (8 * width - 1) and (found := self.text_at((value & 0x7FFFFFFF) + 2)):
                    names.append(found.decode("latin-1"))
                thunk += width
            out.append({"dll": self.text_at(name).decode("latin-1"), "names": names})
            address += 20
        return out

    def _entries(self, root: int, at: int) -> list[tuple[int, bool]]:
        """(offset, is a directory) of the entries of a resource directory."""
        head = self.at(root + at, 16)
        if len(head) < 16:
            return []
        n = sum(struct.unpack("<HH", head[12:]))
        cells = self.at(root + at + 16, 8 * n)
        values = struct.unpack(f"<{len(cells) // 8 * 2}I", cells[: len(cells) // 8 * 8])[1::2]
        return [(v & 0x7FFFFFFF, bool(v >> 31)) for v in values]

    def resources(self) -> list[dict]:
        """Size and entropy of the data below type, id and language."""
        if len(self.directories) < 3 or not self.directories[2][0]:
            return []
        root, out = self.directories[2][0], []
        for kind, deep in self._entries(root, 0):
            for name, deeper in self._entries(root, kind) if deep else ():
                for leaf, directory in self._entries(root, name) if deeper else ():
                    if not directory and len(cell := self.at(root + leaf, 8)) == 8:
                        address, size = struct.unpack("<II", cell)
                        out.append({"size": size, "entropy": entropy(self.at(address, size))})
        return out


def section_name(raw: bytes) -> str:
    """UTF-8 without trailing zero bytes; what isn't UTF-8 as Python writes bytes."""
    try:
        return raw.decode().rstrip("\0")
    except UnicodeDecodeError:
        return str(raw)


def parsed(data: bytes | None) -> dict:
    """A file as PE_TYPE. Failures are kept in the error fields."""
    try:
        image = Image(data or b"")
    except PEError as e:
        return {"error": str(e), "imports_error": str(e), "code_error": str(e)}
    out = {"machine": image.machine, "NumberOfSections": image.n_sections, "SizeOfOptionalHeader": image.optional_size, "characteristics": image.characteristics}
    out |= {k: v if v < 1 << 63 else v - (1 << 64) for k, v in image.optional.items()}
    out["sections"] = [s | {"name": section_name(s["name"]), "physicalAddress": s["virtualSize"], "entropy": entropy(image.content(s))} for s in image.sections]
    for key, read in (("imports", image.imports), ("resources", image.resources)):
        try:
            out[key] = read()
        except Exception as e:  # malformed directories
            out |= {key: [], f"{key}_error": f"{type(e).__name__}: {e}"}
    code = image.section_of(image.optional["AddressOfEntryPoint"])
    if code is None:
        out["code_error"] = "no section holds the entry point"
    else:
        address = image.optional["ImageBase"] + code["virtualAddress"]
        out |= {"code": image.content(code), "code_address": address if address < 1 << 63 else address - (1 << 64)}
    return out


def parse_pe_function():
    """The parser as an Arrow UDF, one call for each batch; also for spark.udf.register."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(PE_TYPE))

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([parsed(x.as_py()) for x in batch], type=kind)

    return F.arrow_udf(run, PE_TYPE)


def parse_pe(content: Column) -> Column:
    """The nested column."""
    return parse_pe_function()(content)
