"""Archive volumes (formats 4 and 5) and header-only skeletons: parse, encode, verify, rebuild, patch.

A parsed block is a plain dict of the columns of BLOCK, so that a source is
one Arrow batch of such rows.  Fixed values: block types, flags, markers.
"""

from __future__ import annotations

import datetime as dt
import struct
import zlib
from collections.abc import Iterator

from quarry.sources.codecs.bits import dos_time, leb, to_leb, u16, u32

MARK4, MARK5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
ARCHIVE, FILE, COMMENT, PROTECT, SERVICE, END = 0x73, 0x74, 0x75, 0x78, 0x7A, 0x7B
SPLIT_BEFORE, SPLIT_AFTER, PASSWORD, SOLID, LARGE, UNICODE, SALT, EXT_TIME, LONG_BLOCK = 0x1, 0x2, 0x4, 0x10, 0x100, 0x200, 0x400, 0x1000, 0x8000
TYPES4 = {0x72: "Marker", 0x73: "Archive Header", 0x74: "File Header", 0x75: "Comment", 0x76: "Auth Info", 0x77: "Old Service", 0x78: "Protect", 0x79: "Sign", 0x7A: "Service Block", 0x7B: "End Archive"}
TYPES5 = {1: "Main Archive Header", 2: "File Header", 3: "Service Header", 4: "Encryption Header", 5: "End of Archive"}
#: Flag of an end block that holds the checksum of the data before it.
DATA_CRC = 0x2
S_HEADER, S_STORED, S_OSO, S_PADDING, S_VOLUME = 0x69, 0x6A, 0x6B, 0x6C, 0x71
SKELETON_TYPES = {0x69: "Header", 0x6A: "StoredFile", 0x6B: "OSOHash", 0x6C: "RARPadding", 0x71: "RARFile"}
SENTINELS = {t: t * 0x101 for t in SKELETON_TYPES}

BLOCK = (
    "block_no int, format int, pos long, crc long, crc_valid boolean, type int, type_name string, flags long, header_size long, add_size long,"
    " name string, is_dir boolean, unpacked_size decimal(20,0), host_os int, file_crc long, dos_time long, mtime timestamp_ntz, ctime timestamp_ntz, atime timestamp_ntz,"
    " unp_ver int, method int, dict_kb long, attributes long, split_before boolean, split_after boolean, data_offset long, volume string, error string"
)
COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def row(**given) -> dict:
    return dict.fromkeys(COLUMNS) | given


def unicode_name(raw: bytes, packed: bytes) -> str:
    """A name from its plain bytes and the packed high bytes and differences."""
    out: list[int] = []
    if not packed:
        return raw.decode("latin-1")
    high, at, flags, bits = packed[0], 1, 0, 0
    while at < len(packed):
        if not bits:
            flags, bits, at = packed[at], 8, at + 1
        bits -= 2
        kind = flags >> bits & 3
        if at >= len(packed):
            break
        if kind == 0:
            out.append(packed[at])
            at += 1
        elif kind == 1:
            out.append(packed[at] | high << 8)
            at += 1
        elif kind == 2:
            if at + 1 >= len(packed):
                break
            out.append(packed[at] | packed[at + 1] << 8)
            at += 2
        else:
            run = packed[at]
            at += 1
            n = (run & 0x7F) + 2
            if run & 0x80:
                if at >= len(packed):
                    break
                shift = packed[at]
                at += 1
                out += [(raw[len(out) + k] + shift & 0xFF) | high << 8 for k in range(n) if len(out) + k < len(raw)]
            else:
                start = len(out)
                out += [raw[start + k] for k in range(n) if start + k < len(raw)]
    return b"".join(struct.pack("<H", c) for c in out).decode("utf-16-le", "replace")


def name4(raw: bytes, flags: int, page: str = "cp437") -> str:
    """A format-4 name: UTF-8 or packed Unicode when flagged, else in an 8-bit page."""
    if flags & UNICODE:
        plain, zero, packed = raw.partition(b"\0")
        return unicode_name(plain, packed) if zero else raw.decode("utf-8", "replace")
    return raw.decode(page)


def extended_times(header: bytes, at: int, base: int) -> list[dt.datetime | None]:
    """Modified, created and accessed time from the flags and remainders behind a name."""
    times: list[dt.datetime | None] = [dos_time(base), None, None]
    if at + 2 > len(header):
        return times
    modes, at = u16(header, at), at + 2
    for i in range(3):
        mode = modes >> (12 - 4 * i) & 15
        if not mode & 8:
            continue
        stamp = base
        if i:
            if at + 4 > len(header):
                break
            stamp, at = u32(header, at), at + 4
        count = mode & 3
        if at + count > len(header):
            break
        rest = sum(header[at + j] << (j + 3 - count) * 8 for j in range(count))
        at += count
        when = dos_time(stamp)
        if when is not None:
            when += dt.timedelta(seconds=bool(mode & 4), microseconds=rest // 10)
        times[i] = when
    return times


def block4(data: bytes, at: int) -> dict | None:
    """The format-4 block at a position; None when it doesn't fit."""
    if at + 7 > len(data):
        return None
    crc, kind, flags, size = u16(data, at), data[at + 2], u16(data, at + 3), u16(data, at + 5)
    if size < 7 or at + size > len(data):
        return None
    header = data[at : at + size]
    out = row(format=4, pos=at, crc=crc, crc_valid=zlib.crc32(header[2:]) & 0xFFFF == crc or header == MARK4, type=kind, type_name=TYPES4.get(kind, f"Unknown (0x{kind:02X})"), flags=flags, header_size=size, add_size=0, data_offset=at + size)
    if flags & LONG_BLOCK or kind in (FILE, SERVICE):
        if at + 11 > len(data):
            return None
        out["add_size"] = u32(data, at + 7)
    if kind in (FILE, SERVICE) and size >= 32:
        unpacked, host, file_crc, stamp, ver, method, length, attr = struct.unpack_from("<IBIIBBHI", header, 11)
        name_at = 32
        if flags & LARGE and size >= 40:
            high, high_unpacked = struct.unpack_from("<II", header, 32)
            out["add_size"] |= high << 32
            unpacked |= high_unpacked << 32
            name_at = 40
        raw = header[name_at : name_at + length]
        name = name4(raw, flags) if len(raw) == length and length else None
        times = extended_times(header, name_at + length + (8 if flags & SALT else 0), stamp) if flags & EXT_TIME else [dos_time(stamp), None, None]
        out |= dict(zip(("mtime", "ctime", "atime"), times, strict=True))
        if kind == FILE and method >= 0x30:
            method -= 0x30
        out |= {"name": name, "is_dir": flags & 0xE0 == 0xE0 or bool(name) and name[-1] in "\\/", "unpacked_size": unpacked, "host_os": host, "file_crc": file_crc, "dos_time": stamp, "unp_ver": ver, "method": method}
        out |= {"dict_kb": (64 << (flags >> 5 & 7)) % 8192, "attributes": attr, "split_before": bool(flags & SPLIT_BEFORE), "split_after": bool(flags & SPLIT_AFTER)}
    return out


def block5(data: bytes, at: int) -> dict | None:
    """The format-5 block at a position; None when it doesn't fit."""
    if at + 5 > len(data):
        return None
    try:
        crc = u32(data, at)
        size, start = leb(data, at + 4, len(data))
        end = start + size
        if end > len(data):
            return None
        kind, p = leb(data, start, len(data))
        flags, p = leb(data, p, len(data))
        extra, p = leb(data, p, len(data)) if flags & 1 else (0, p)
        body, p = leb(data, p, len(data)) if flags & 2 else (0, p)
        out = row(format=5, pos=at, crc=crc, crc_valid=zlib.crc32(data[at + 4 : end]) == crc, type=kind & 0xFF, type_name=TYPES5.get(kind, "Unknown"), flags=flags, header_size=end - at, add_size=min(body, 2**63 - 1), data_offset=end, split_before=bool(flags & 8), split_after=bool(flags & 16))
        if kind in (2, 3):
            file_flags, p = leb(data, p, end)
            unpacked, p = leb(data, p, end) if not file_flags & 8 else (0, p)
            attr, p = leb(data, p, end)
            mtime, p = (u32(data, p), p + 4) if file_flags & 2 else (None, p)
            file_crc, p = (u32(data, p), p + 4) if file_flags & 4 else (None, p)
            info, p = leb(data, p, end)
            host, p = leb(data, p, end)
            length, p = leb(data, p, end)
            name = data[p : p + length].decode("utf-8", "replace") if p + length <= end else ""
            when = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=mtime) if mtime is not None else None
            out |= {"name": name, "is_dir": bool(file_flags & 1), "unpacked_size": unpacked, "attributes": attr & (2**63 - 1), "mtime": when, "file_crc": file_crc, "unp_ver": 50 if info & 0x3F == 0 else 70, "method": 0x30 + (info >> 7 & 7), "dict_kb": 128 << (info >> 10 & 15), "host_os": host & 0xFF}
        del extra
        return out
    except (ValueError, struct.error):
        return None


def marker(data: bytes, scan: int = 1 << 20) -> tuple[int, int]:
    """(format, position behind the marker) of an archive, behind a stub of at most scan bytes; (0, 0) without one."""
    for mark, form in ((MARK5, 5), (MARK4, 4)):
        at = data.find(mark, 0, scan + len(mark))
        if at >= 0:
            return form, at + len(mark)
    return 0, 0


def volume_blocks(data: bytes) -> Iterator[dict]:
    """Blocks of a volume, up to the first that doesn't fit."""
    form, at = marker(data)
    n = 0
    while form and at < len(data):
        b = block4(data, at) if form == 4 else block5(data, at)
        if b is None:
            break
        yield b | {"block_no": n}
        n, at = n + 1, b["data_offset"] + b["add_size"]


def skeleton_blocks(data: bytes) -> Iterator[dict]:
    """Blocks of a skeleton, with the headers it holds for each volume; ends at the first block that doesn't fit.

    A block that doesn't fit is told as a last row with an error, which
    sources leave out and the verifier reads.
    """
    at = n = 0
    while at < len(data):
        bad = lambda why: row(block_no=n, format=0, pos=at, error=why)  # noqa: B023, E731
        if at + 7 > len(data):
            yield bad("truncated header")
            return
        crc, kind, flags, size = u16(data, at), data[at + 2], u16(data, at + 3), u16(data, at + 5)
        if kind not in SKELETON_TYPES:
            yield bad("unknown block")
            return
        long = bool(flags & LONG_BLOCK) or kind == S_STORED
        if long and at + 11 > len(data):
            yield bad("truncated size")
            return
        add = u32(data, at + 7) if long else 0
        if size < 7 or at + size + add > len(data):
            yield bad("block overruns file")
            return
        out = row(block_no=n, format=0, pos=at, crc=crc, crc_valid=crc == SENTINELS[kind], type=kind, type_name=SKELETON_TYPES[kind], flags=flags, header_size=size, add_size=add, data_offset=at + size)
        p, end = at + (11 if long else 7), at + size
        if kind == S_OSO and p + 16 <= end:
            out |= {"unpacked_size": int.from_bytes(data[p : p + 8], "little"), "file_crc": None}
            p += 16
        named = kind != S_HEADER or flags & 1
        if named and p + 2 <= (len(data) if kind == S_VOLUME else end):
            length = u16(data, p)
            if p + 2 + length <= (len(data) if kind == S_VOLUME else end):
                out["name"] = data[p + 2 : p + 2 + length].decode("utf-8", "replace")
        if named and out["name"] is None and kind in (S_STORED, S_VOLUME):
            yield bad("name overruns header")
            return
        yield out
        n, at = n + 1, end + add
        if kind == S_VOLUME:
            volume = out["name"]
            form = 5 if data[at : at + 8] == MARK5 else 4
            at += 8 if form == 5 else 0
            while at < len(data):
                peek = data[at + 2] if form == 4 and at + 2 < len(data) else None
                if form == 5 and at + 2 < len(data):
                    peek = data[at + 2] if data[at] == data[at + 1] == data[at + 2] else None
                if peek in SKELETON_TYPES:
                    break
                b = block4(data, at) if form == 4 else block5(data, at)
                if b is None:
                    yield bad("embedded header overruns file")
                    return
                yield b | {"block_no": n, "volume": volume}
                n += 1
                at = b["data_offset"] + (0 if b["type"] == (FILE if form == 4 else 2) else b["add_size"])


def skeleton_block(kind: int, body: bytes = b"", data: bytes = b"", flags: int = 0) -> bytes:
    """One block of a skeleton; stored files and blocks with data carry their size."""
    long = kind == S_STORED or bool(data)
    head = body if not long else struct.pack("<I", len(data)) + body
    return struct.pack("<HBHH", SENTINELS[kind], kind, flags | (LONG_BLOCK if long else 0), 7 + len(head)) + head + data


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<H", len(raw)) + raw


def skeleton_header(app: str | None) -> bytes:
    return skeleton_block(S_HEADER, text(app) if app else b"", flags=1 if app else 0)


def stored_block(name: str, data: bytes) -> bytes:
    return skeleton_block(S_STORED, text(name), data)


def oso_block(name: str, size: int, digest: bytes) -> bytes:
    return skeleton_block(S_OSO, struct.pack("<Q", size) + digest + text(name))


def volume_block(name: str) -> bytes:
    return skeleton_block(S_VOLUME, text(name), flags=1)


def kept_headers(data: bytes) -> bytes:
    """The headers of a volume as a skeleton keeps them: no file data; comments with their data."""
    form, at = marker(data)
    out = [MARK5 if form == 5 else MARK4] if form else []
    for b in volume_blocks(data):
        out.append(data[b["pos"] : b["data_offset"]])
        is_file = b["type"] == (FILE if form == 4 else 2)
        if not is_file and b["add_size"]:
            out.append(data[b["data_offset"] : b["data_offset"] + b["add_size"]])
    return b"".join(out)


def make_skeleton(volumes: list[tuple[str, bytes]], stored: list[tuple[str, bytes]] = (), app: str | None = "quarry") -> bytes:
    """A skeleton of (name, bytes) volumes in order, with stored files in front."""
    parts = [skeleton_header(app), *(stored_block(n, d) for n, d in stored)]
    for name, data in volumes:
        parts += [volume_block(name), kept_headers(data)]
    return b"".join(parts)


def rebuild_volumes(skeleton: bytes, payload: dict[str, bytes]) -> dict[str, bytes]:
    """Volumes from a skeleton and each file's packed data; a piece takes its size from where the last one ended."""
    out: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    blocks = list(skeleton_blocks(skeleton))
    for b in blocks:
        if b["error"] and b["error"] != "unknown block":
            raise ValueError(f"skeleton is broken at {b['pos']}: {b['error']}")
        if b["format"] == 0 and b["type"] == S_VOLUME:
            out[b["name"]] = [MARK5] if skeleton[b["pos"] + b["header_size"] :][:8] == MARK5 else []
        elif b["format"]:
            parts = out[b["volume"]]
            parts.append(skeleton[b["pos"] : b["data_offset"]])
            if b["type"] == (FILE if b["format"] == 4 else 2):
                at = used.get(b["name"], 0)
                piece = payload[b["name"]][at : at + b["add_size"]]
                if len(piece) < b["add_size"]:
                    raise ValueError(f"payload of {b['name']} ends early")
                used[b["name"]] = at + b["add_size"]
                parts.append(piece)
            elif b["add_size"]:
                parts.append(skeleton[b["data_offset"] : b["data_offset"] + b["add_size"]])
        elif b["format"] == 0 and b["type"] == S_PADDING and b["name"] in out:
            out[b["name"]].append(skeleton[b["data_offset"] : b["data_offset"] + b["add_size"]])
    return {name: b"".join(parts) for name, parts in out.items()}


def patch4(data: bytes, host: int | None = None, attributes: int | None = None, mtimes: dict[str, int] | None = None) -> bytes:
    """A format-4 volume with file headers' host, attributes or DOS times replaced, and their checksums made anew."""
    out = bytearray(data)
    for b in volume_blocks(data):
        if b["type"] not in (FILE, SERVICE) or b["header_size"] < 32 or b["format"] != 4:
            continue
        at, size = b["pos"], b["header_size"]
        if host is not None:
            out[at + 15] = host
        if b["type"] == FILE and attributes is not None:
            struct.pack_into("<I", out, at + 28, attributes)
        if b["type"] == FILE and mtimes and b["name"] in mtimes:
            struct.pack_into("<I", out, at + 20, mtimes[b["name"]])
        struct.pack_into("<H", out, at, zlib.crc32(out[at + 2 : at + size]) & 0xFFFF)
    return patch_end(bytes(out))


def patch_end(data: bytes) -> bytes:
    """A format-4 volume whose end block, where it holds one, has the checksum of all bytes before it."""
    out = bytearray(data)
    for b in volume_blocks(data):
        at, size = b["pos"], b["header_size"]
        if b["format"] == 4 and b["type"] == END and b["flags"] & DATA_CRC and size >= 11:
            struct.pack_into("<I", out, at + 7, zlib.crc32(out[:at]))
            struct.pack_into("<H", out, at, zlib.crc32(out[at + 2 : at + size]) & 0xFFFF)
    return bytes(out)


def first_name(data: bytes) -> str | None:
    """Name of a volume's first file, with backslashes; None for what isn't a volume from its first byte, or has no file."""
    if not data.startswith((MARK4, MARK5)):
        return None
    found = next((b["name"] for b in volume_blocks(data) if b["type"] == (FILE if b["format"] == 4 else 2) and b["name"]), None)
    return found and found.replace("/", "\\")


def patch_large(data: bytes, add: bool) -> bytes:
    """A format-4 volume with the 64-bit size fields of its file headers added or removed."""
    out, last, form = [], 0, marker(data)[0]
    if form != 4:
        return data
    for b in volume_blocks(data):
        at, size, flags = b["pos"], b["header_size"], b["flags"]
        if b["type"] != FILE or size < 32 or bool(flags & LARGE) == add or (not add and (b["add_size"] | int(b["unpacked_size"])) >> 32):
            continue
        h = bytearray(data[at : at + size])
        h[32 : 32 if add else 40] = bytes(8) if add else b""
        struct.pack_into("<HH", h, 3, flags ^ LARGE, len(h))
        struct.pack_into("<H", h, 0, zlib.crc32(h[2:]) & 0xFFFF)
        out += [data[last:at], bytes(h)]
        last = at + size
    return b"".join([*out, data[last:]])


def file4(name: str, data: bytes, flags: int = 0, stamp: int = 0x5A8E3100, host: int = 2, unpacked: int | None = None, crc: int | None = None) -> bytes:
    """A format-4 file block in store mode."""
    raw = name.encode("cp437")
    body = struct.pack("<IIBIIBBHI", len(data), len(data) if unpacked is None else unpacked, host, zlib.crc32(data) if crc is None else crc, stamp, 29, 0x30, len(raw), 0x20)
    rest = struct.pack("<BHH", FILE, flags | LONG_BLOCK, 7 + len(body) + len(raw)) + body + raw
    return struct.pack("<H", zlib.crc32(rest) & 0xFFFF) + rest + data


def simple4(kind: int, flags: int = 0, body: bytes = b"") -> bytes:
    rest = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
    return struct.pack("<H", zlib.crc32(rest) & 0xFFFF) + rest


def volume4(pieces: list[bytes], flags: int = 0) -> bytes:
    """A format-4 volume of ready file blocks."""
    return MARK4 + simple4(ARCHIVE, flags, bytes(6)) + b"".join(pieces) + simple4(END)


def file5(name: str, data: bytes, flags: int = 0, crc: int | None = None) -> bytes:
    """A format-5 file block in store mode."""
    raw = name.encode()
    body = to_leb(2) + to_leb(flags | 2) + to_leb(len(data)) + to_leb(4) + to_leb(len(data)) + to_leb(0x20) + struct.pack("<I", zlib.crc32(data) if crc is None else crc) + to_leb(0) + to_leb(1) + to_leb(len(raw)) + raw
    sized = to_leb(len(body)) + body
    return struct.pack("<I", zlib.crc32(sized)) + sized + data


def simple5(kind: int, flags: int = 0, body: bytes = b"") -> bytes:
    sized = to_leb(2 + len(body)) + to_leb(kind) + to_leb(flags) + body
    return struct.pack("<I", zlib.crc32(sized)) + sized


def volume5(pieces: list[bytes]) -> bytes:
    return MARK5 + simple5(1, 0, to_leb(0)) + b"".join(pieces) + simple5(5, 0, to_leb(0))


def oso_hash(data: bytes) -> bytes | None:
    """Size plus the 64-bit sums of the first and last 64 KiB, modulo 2^64, little-endian; None under 64 KiB."""
    import numpy as np

    if len(data) < 65_536:
        return None
    total = np.frombuffer(data[:65_536] + data[-65_536:], dtype="<u8").sum(dtype=np.uint64)
    return ((int(total) + len(data)) % 2**64).to_bytes(8, "little")
