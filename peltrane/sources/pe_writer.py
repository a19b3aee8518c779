"""PE files written from the public layout: synthetic corpora for queries, tests and benchmarks."""

from __future__ import annotations

import struct

ALIGN = 512


def name8(name: bytes) -> bytes:
    return name[:8].ljust(8, b"\0")


def build(sections=((b".text", b"\x90" * 600, 0x1000),), *, plus=False, machine=0x14C, entry=0x1010, flags=0x0102, imports=(), resources=(), base=0x400000, opt=None) -> bytes:
    """sections: (name, bytes, address[, virtual size, flags]). imports: (dll, [name or None: by ordinal]). resources: bytes."""
    sections = [list(s) + [None, 0x60000020][len(s) - 3 :] for s in sections]
    directories = [[0, 0] for _ in range(16)]
    last = max([s[2] + max(len(s[1]), s[3] or 0) for s in sections], default=0x1000)
    free = (last + 0xFFF) // 0x1000 * 0x1000
    if imports:
        blob = import_table(imports, free, plus)
        directories[1] = [free, len(blob)]
        sections.append([b".idata", blob, free, None, 0x40000040])
        free = (free + len(blob) + 0xFFF) // 0x1000 * 0x1000
    if resources:
        blob = resource_table(resources, free)
        directories[2] = [free, len(blob)]
        sections.append([b".rsrc", blob, free, None, 0x40000040])
        free += 0x10000
    optional_size = 96 + (16 if plus else 0) + 128
    headers = 64 + 24 + optional_size + 40 * len(sections)
    raw = (headers + ALIGN - 1) // ALIGN * ALIGN
    header_size, table, body = raw, b"", b""
    for name, data, address, vsize, bits in sections:
        size = (len(data) + ALIGN - 1) // ALIGN * ALIGN
        table += struct.pack("<8sIIIIIIHHI", name8(name), len(data) if vsize is None else vsize, address, size, raw if size else 0, 7, 0, 3, 0, bits)
        body += data.ljust(size, b"\0")
        raw += size
    v = {"code": 1024, "data": 512, "bss": 256, "entry": entry} | (opt or {})
    if plus:
        optional = struct.pack("<HBBIIIIIQII", 0x20B, 14, 0, v["code"], v["data"], v["bss"], v["entry"], 0x1000, base, 0x1000, ALIGN)
    else:
        optional = struct.pack("<HBBIIIIIIIII", 0x10B, 14, 0, v["code"], v["data"], v["bss"], v["entry"], 0x1000, 0x2000, base, 0x1000, ALIGN)
    optional += struct.pack("<HHHHHHIIIIHH", 6, 0, 0, 0, 6, 0, 0, free, header_size, 0, 3, 0)
    optional += struct.pack("<QQQQ" if plus else "<IIII", 1 << 20, 4096, 1 << 20, 4096) + struct.pack("<II", 0, 16)
    optional += b"".join(struct.pack("<II", *d) for d in directories)
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0"
    head += struct.pack("<HHIIIHH", machine, len(sections), 0, 0, 0, optional_size, flags) + optional + table
    return head.ljust(header_size, b"\0") + body


def import_table(imports, base, plus):
    width = 8 if plus else 4
    descriptors, rest = b"", b""
    at = base + 20 * (len(imports) + 1)
    for dll, names in imports:
        place, cells = at + len(rest), b""
        rest += dll.encode() + b"\0"
        for n in names:
            if n is None:
                cells += ((1 << (8 * width - 1)) | 5).to_bytes(width, "little")
            else:
                cells += (at + len(rest)).to_bytes(width, "little")
                rest += b"\0\0" + n.encode() + b"\0"
        table = at + len(rest)
        rest += cells + bytes(width)
        descriptors += struct.pack("<IIIII", table, 0, 0, place, table)
    return descriptors + bytes(20) + rest


def resource_table(resources, base):
    """One type, one id, a language for each."""
    n = len(resources)
    root = struct.pack("<IIHHHH", 0, 0, 0, 0, 0, 1) + struct.pack("<II", 3, 24 | 1 << 31)
    second = struct.pack("<IIHHHH", 0, 0, 0, 0, 0, 1) + struct.pack("<II", 1, 48 | 1 << 31)
    leaves = 64 + 8 * n
    third = struct.pack("<IIHHHH", 0, 0, 0, 0, 0, n) + b"".join(struct.pack("<II", k, leaves + 16 * k) for k in range(n))
    at, cells, data = base + leaves + 16 * n, b"", b""
    for r in resources:
        cells += struct.pack("<IIII", at + len(data), len(r), 0, 0)
        data += r
    return root + second + third + cells + data
