"""Blocks of a format-4 or format-5 volume as named fields with their place: the detailed view.

A field is (block_no, field_no, parent_field_no, name, offset, length, raw,
value, description).  The layouts are tables of (name, struct format, show).
Fixed values: names, record types and bits of the two formats.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from quarry.functions.scalars import DICTIONARIES, HOSTS, METHODS
from quarry.sources.codecs import archive
from quarry.sources.codecs.bits import dos_time, leb

FIELD = "block_no int, block string, field_no int, parent_field_no int, name string, offset long, length int, raw binary, value string, description string"

ARCHIVE_BITS = [(0x1, "VOLUME"), (0x2, "COMMENT"), (0x4, "LOCK"), (0x8, "SOLID"), (0x10, "NEW_NUMBERING"), (0x20, "AUTH_INFO"), (0x40, "PROTECTED"), (0x80, "PASSWORD"), (0x100, "FIRST_VOLUME")]
FILE_BITS = [(0x1, "SPLIT_BEFORE"), (0x2, "SPLIT_AFTER"), (0x4, "PASSWORD"), (0x8, "COMMENT"), (0x10, "SOLID"), (0x100, "LARGE"), (0x200, "UNICODE"), (0x400, "SALT"), (0x800, "VERSION"), (0x1000, "EXT_TIME"), (0x8000, "LONG_BLOCK")]
END_BITS = [(0x1, "NEXT_VOLUME"), (0x2, "DATA_CRC"), (0x4, "REV_SPACE"), (0x8, "VOLUME_NUMBER")]
BITS5 = [(0x1, "EXTRA_AREA"), (0x2, "DATA_AREA"), (0x4, "SKIP_IF_UNKNOWN"), (0x8, "SPLIT_BEFORE"), (0x10, "SPLIT_AFTER"), (0x20, "CHILD"), (0x40, "INHERITED")]
FILE_BITS5 = [(0x1, "DIRECTORY"), (0x2, "TIME_PRESENT"), (0x4, "CRC32_PRESENT"), (0x8, "UNKNOWN_SIZE")]
ARCHIVE_BITS5 = [(0x1, "VOLUME"), (0x2, "VOLUME_NUMBER"), (0x4, "SOLID"), (0x8, "RECOVERY_RECORD"), (0x10, "LOCKED")]
EXTRA = {(1, 1): "Locator", (1, 2): "Metadata", (2, 1): "Encryption", (2, 2): "Hash", (2, 3): "Time", (2, 4): "Version", (2, 5): "Redirection", (2, 6): "Owner", (2, 7): "Service Data"}


def host(v: int) -> str:
    return HOSTS[v] if v < len(HOSTS) else f"Unknown ({v})"


def method(v: int) -> str:
    k = v - 0x30 if v >= 0x30 else v
    return METHODS[k] if k < len(METHODS) else "Unknown"


def stamp(v: int) -> str:
    t = dos_time(v)
    return t.isoformat(" ") if t else "none"


FILE4: list[tuple[str, str, Callable[[int], str] | None]] = [
    ("Packed Size", "I", None), ("Unpacked Size", "I", None), ("Host OS", "B", host), ("File CRC", "I", "{:08X}".format), ("File Time", "I", stamp),
    ("Unpack Version", "B", lambda v: f"{v // 10}.{v % 10}"), ("Method", "B", method), ("Name Size", "H", None), ("Attributes", "I", "0x{:08X}".format),
]


class Sheet:
    """Fields of one block, read one after the other."""

    def __init__(self, data: bytes, block_no: int, block: str):
        self.data, self.head, self.out = data, {"block_no": block_no, "block": block}, []

    def put(self, name: str, at: int, n: int, value: object, described: str = "", parent: int | None = None) -> int:
        no = len(self.out)
        self.out.append(self.head | {"field_no": no, "parent_field_no": parent, "name": name, "offset": at, "length": n, "raw": self.data[at : at + n], "value": str(value), "description": described})
        return no

    def fixed(self, name: str, at: int, form: str, show: Callable[[int], str] | None = None, parent: int | None = None) -> tuple[int, int]:
        """A little-endian number; gives its value and its field's number."""
        v = struct.unpack_from("<" + form, self.data, at)[0]
        return v, self.put(name, at, struct.calcsize("<" + form), v, show(v) if show else "", parent)

    def number(self, name: str, at: int, end: int, show: Callable[[int], str] | None = None, parent: int | None = None) -> tuple[int, int, int]:
        """A variable-length number; gives its value, the next position and its field's number."""
        v, after = leb(self.data, at, end)
        return v, after, self.put(name, at, after - at, v, show(v) if show else "", parent)

    def bits(self, parent: int, at: int, n: int, value: int, table: list[tuple[int, str]]) -> None:
        for mask, name in table:
            self.put(name, at, n, "set" if value & mask else "unset", f"0x{mask:04X}", parent)


def fields4(data: bytes, b: dict) -> Iterator[dict]:
    at, kind, end = b["pos"], b["type"], b["data_offset"]
    s = Sheet(data, b["block_no"], b["type_name"])
    s.fixed("Header CRC", at, "H", lambda _: "valid" if b["crc_valid"] else "invalid")
    s.fixed("Header Type", at + 2, "B", lambda _: b["type_name"])
    flags, no = s.fixed("Flags", at + 3, "H", "0x{:04X}".format)
    s.bits(no, at + 3, 2, flags, {archive.ARCHIVE: ARCHIVE_BITS, archive.FILE: FILE_BITS, archive.SERVICE: FILE_BITS, archive.END: END_BITS}.get(kind, []))
    if kind in (archive.FILE, archive.SERVICE):
        s.put("Dictionary", at + 3, 2, DICTIONARIES[flags >> 5 & 7], "KB; 0: directory", no)
    s.fixed("Header Size", at + 5, "H")
    p = at + 7
    if kind in (archive.FILE, archive.SERVICE) and b["header_size"] >= 32:
        values = {}
        for name, form, show in FILE4:
            values[name], _ = s.fixed(name, p, form, show)
            p += struct.calcsize("<" + form)
        if flags & archive.LARGE and p + 8 <= end:
            s.fixed("High Packed Size", p, "I")
            s.fixed("High Unpacked Size", p + 4, "I")
            p += 8
        n = min(values["Name Size"], end - p)
        s.put("File Name", p, n, b["name"])
        p += n
        if flags & archive.SALT and p + 8 <= end:
            s.put("Salt", p, 8, data[p : p + 8].hex())
            p += 8
        if flags & archive.EXT_TIME and p < end:
            times = [f"{k}: {b[k]}" for k in ("mtime", "ctime", "atime") if b[k]]
            s.put("Extended Time", p, end - p, "; ".join(times))
    elif p < end:
        if flags & archive.LONG_BLOCK and p + 4 <= end:
            s.fixed("Add Size", p, "I")
            p += 4
        if p < end:
            s.put("Body", p, end - p, data[p:end].hex())
    yield from s.out


def fields5(data: bytes, b: dict) -> Iterator[dict]:
    at, end = b["pos"], b["data_offset"]
    s = Sheet(data, b["block_no"], b["type_name"])
    s.fixed("Header CRC32", at, "I", lambda _: "valid" if b["crc_valid"] else "invalid")
    _, p, _ = s.number("Header Size", at + 4, end)
    kind, p, _ = s.number("Header Type", p, end, lambda _: b["type_name"])
    start = p
    flags, p, no = s.number("Header Flags", p, end, "0x{:04X}".format)
    s.bits(no, start, p - start, flags, BITS5)
    extra, p, _ = s.number("Extra Area Size", p, end) if flags & 1 else (0, p, 0)
    if flags & 2:
        _, p, _ = s.number("Data Size", p, end)
    if kind == 1:
        start = p
        own, p, no = s.number("Archive Flags", p, end, "0x{:04X}".format)
        s.bits(no, start, p - start, own, ARCHIVE_BITS5)
        if own & 2:
            _, p, _ = s.number("Volume Number", p, end)
    elif kind in (2, 3):
        start = p
        own, p, no = s.number("File Flags", p, end, "0x{:04X}".format)
        s.bits(no, start, p - start, own, FILE_BITS5)
        if not own & 8:
            _, p, _ = s.number("Unpacked Size", p, end)
        _, p, _ = s.number("Attributes", p, end, "0x{:X}".format)
        for bit, name, show in ((2, "Modification Time", str), (4, "File CRC", "{:08X}".format)):
            if own & bit:
                s.fixed(name, p, "I", show)
                p += 4
        start = p
        info, p, no = s.number("Compression Info", p, end)
        for name, v in (("Version", info & 0x3F), ("Solid", info >> 6 & 1), ("Method", info >> 7 & 7), ("Dictionary", 128 << (info >> 10 & 15))):
            s.put(name, start, p - start, v, "KB" if name == "Dictionary" else "", no)
        _, p, _ = s.number("Host OS", p, end, lambda v: {0: "Windows", 1: "Unix"}.get(v, f"Unknown ({v})"))
        n, p, _ = s.number("Name Length", p, end)
        s.put("Name", p, min(n, end - p), b["name"])
        p += n
    area = end - extra
    while extra and area < end:
        size, p, _ = s.number("Record Size", area, end)
        tag, q, no = s.number("Record Type", p, end, lambda v: EXTRA.get((kind, v), "Unknown"))
        s.put("Record Data", q, max(p + size - q, 0), data[q : p + size].hex(), "", no)
        if p + size <= area:
            break
        area = p + size
    yield from s.out


def fields(data: bytes) -> Iterator[dict]:
    """All fields of all blocks; a block whose own fields overrun it shows those before."""
    for b in archive.volume_blocks(data):
        made = fields4 if b["format"] == 4 else fields5
        try:
            yield from made(data, b)
        except (ValueError, struct.error):
            yield Sheet(data, b["block_no"], b["type_name"]).head | {"field_no": 0, "parent_field_no": None, "name": "Malformed", "offset": b["pos"], "length": b["header_size"], "raw": None, "value": "", "description": "fields overrun the header"}
