"""Disc images: the files of an ISO 9660 image, their place, and searches over title sets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

SECTOR = 2048
#: Extensions of media on discs.
MEDIA = (".vob", ".m2ts", ".ts", ".mpg", ".mpeg", ".evo", ".m2v", ".avi", ".mkv", ".mp4", ".wmv", ".m4v", ".mov", ".flac", ".mp3")
#: Bytes of a title set that are searched at once.
BUFFER = 32 << 20


def entries(data: bytes) -> Iterator[dict]:
    """(name, offset, size) of all files; directories that an image names twice are read once."""
    base = next((s for s in range(16, 64) if data[s * SECTOR : s * SECTOR + 6] == b"\x01CD001"), None)
    if base is None:
        return
    root = data[base * SECTOR + 156 : base * SECTOR + 190]
    todo, seen = [("", struct.unpack_from("<I", root, 2)[0], struct.unpack_from("<I", root, 10)[0])], set()
    while todo:
        path, extent, size = todo.pop()
        if extent in seen:
            continue
        seen.add(extent)
        at, end = extent * SECTOR, min(extent * SECTOR + size, len(data))
        while at < end:
            n = data[at]
            if not n:  # records don't cross sectors
                at = (at // SECTOR + 1) * SECTOR
                continue
            if at + n > end or n < 34:
                return
            place, length, flags, k = struct.unpack_from("<I", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0], data[at + 25], data[at + 32]
            raw = data[at + 33 : at + 33 + k]
            at += n
            if raw in (b"\0", b"\1"):
                continue
            name = path + raw.decode("latin-1").partition(";")[0]
            if flags & 2:
                todo.append((name + "/", place, length))
            else:
                yield {"name": name, "offset": place * SECTOR, "size": length}


def media_files(data: bytes) -> list[dict]:
    return sorted((e for e in entries(data) if e["name"].lower().endswith(MEDIA)), key=lambda e: e["name"].lower())


def title_sets(data: bytes) -> dict[str, list[dict]]:
    """VOB files of titles (VTS_nn...) by the first six letters of their names, in order; menus belong to none."""
    out: dict[str, list[dict]] = {}
    for e in media_files(data):
        last = e["name"].rpartition("/")[2].upper()
        if last.endswith(".VOB") and last.startswith("VTS_"):
            out.setdefault(last[:6], []).append(e)
    return {k: sorted(v, key=lambda e: e["name"].upper()) for k, v in sorted(out.items())}


def matching_set(data: bytes, signature: bytes) -> tuple[str, int] | None:
    """The title set that holds a signature, and its offset in the set's files joined; a match may cross files."""
    for title, files in title_sets(data).items():
        held, before = b"", 0  # the end of what was searched, and the bytes of the set in front of it
        for e in files if signature else ():
            for start in range(e["offset"], e["offset"] + e["size"], BUFFER):
                held += data[start : min(start + BUFFER, e["offset"] + e["size"])]
                at = held.find(signature)
                if at >= 0:
                    return title, before + at
                rest = len(held) - min(len(held), len(signature) - 1)
                held, before = held[rest:], before + rest
    return None
