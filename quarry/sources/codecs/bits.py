"""Little helpers on bytes: integers, variable-length integers, DOS times."""

from __future__ import annotations

import datetime as dt
import struct


def u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def u64(data: bytes, at: int) -> int:
    return struct.unpack_from("<Q", data, at)[0]


def leb(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value, next position) of groups of 7 bits, lowest first; 10 bytes at most."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= end:
            raise ValueError("number runs over its header")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
    raise ValueError("number too long")


def to_leb(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int] | None:
    """(value, length) of an EBML number; None if it is cut off or has no marker."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_marker else value & ((1 << (7 * n)) - 1)), n


def to_vint(value: int, size: int | None = None) -> bytes:
    """Shortest EBML number whose bits aren't all ones, or one of the given size."""
    n = size or next(k for k in range(1, 9) if value <= (1 << (7 * k)) - 2)
    return ((1 << (7 * n)) | value).to_bytes(n, "big")


def id_bytes(value: int) -> bytes:
    return value.to_bytes(-(-value.bit_length() // 8), "big")


def lace_sizes(data: bytes, kind: int, total: int) -> tuple[list[int], int]:
    """(frame sizes, bytes of the lacing header) of a block's data; kind 0 none, 2 Xiph, 4 fixed, 6 EBML.

    total: bytes from the lacing header on.
    """
    if kind == 0:
        return [total], 0
    count, at = data[0] + 1, 1
    sizes: list[int] = []
    if kind == 4:
        return [(total - 1) // count] * count, 1
    for i in range(count - 1):
        if kind == 2:
            size = 0
            while True:
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            value, n = vint(data, at) or (0, 1)
            at += n
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * n - 1)) - 1)
        sizes.append(size)
    return [*sizes, total - at - sum(sizes)], at


def dos_time(value: int) -> dt.datetime | None:
    if not value:
        return None
    try:
        return dt.datetime(1980 + (value >> 25), value >> 21 & 15, value >> 16 & 31, value >> 11 & 31, value >> 5 & 63, (value & 31) * 2)
    except ValueError:
        return None


def sync_safe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def to_sync_safe(value: int) -> bytes:
    return bytes(value >> s & 0x7F for s in (21, 14, 7, 0))
