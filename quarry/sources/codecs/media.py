"""Media samples: one walk over each container, from which all else follows.

walk() cuts a container into spans: structure, which a skeleton keeps, and
payload of a track, which it drops; one mark tells where a skeleton holds its
records.  Profiling sums the spans, writing a skeleton copies the structure,
and rebuilding walks the skeleton (whose payloads are missing) and fills each
payload span with the next bytes of its track.

Fixed values: magics, record names, identifiers and flags of the containers.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from quarry.sources.codecs.bits import id_bytes, lace_sizes, sync_safe, to_vint, u32, u64, vint

SIGNATURE, STEPS, WINDOW, RADIUS, BIG = 256, 40, 64, 64 * 1024, 1 << 31
DATA_GUID = bytes.fromhex("3626b2758e66cf11a6d900aa0062ce6c")
HEADER_GUID = bytes.fromhex("3026b2758e66cf11")
ASF_FILE, ASF_TRACK, ASF_PAD = b"SRSFSRSFSRSFSRSF", b"SRSTSRSTSRSTSRST", b"PADDINGBYTESDATA"
STREAM_NAMES = (".vob", ".mpeg", ".mpg", ".m2ts", ".ts", ".m2v", ".evo")
EBML_SEGMENT, EBML_CLUSTER, EBML_GROUP, EBML_BLOCK, EBML_SIMPLE = 0x18538067, 0x1F43B675, 0xA0, 0xA1, 0xA3
EBML_TRACKS, EBML_TRACK, EBML_ATTACHMENTS, EBML_ATTACHED, EBML_FILE_DATA = 0x1654AE6B, 0xAE, 0x1941A469, 0x61A7, 0x465C
EBML_RECORDS, EBML_FILE_RECORD, EBML_TRACK_RECORD = 0x1F697576, 0x6A75, 0x6B75
CONTAINERS = {EBML_SEGMENT, EBML_CLUSTER, EBML_GROUP, EBML_TRACKS, EBML_TRACK, EBML_ATTACHMENTS, EBML_ATTACHED, 0x6D80, 0x6240, 0x5034}
MP4_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


class Span(NamedTuple):
    """Bytes of a container: structure (track None), payload of a track, or a record of a skeleton (record set).

    start and end are positions in the walked bytes; a payload that a
    skeleton lacks has start == end, and size says how long it was.
    """

    start: int
    end: int
    track: int | None = None
    size: int = 0
    record: str | None = None


INJECT = Span(-1, -1)


def sniff(data: bytes, name: str = "") -> str | None:
    """Container of a file, by magic bytes, then name, then MP3 marks; None if unknown."""
    low = name.lower()
    if data[:4] == b"RIFF":
        return "MP3" if low.endswith(".mp3") else "AVI"
    if data[:4] == b"\x1a\x45\xdf\xa3":
        return "MKV"
    if data[4:8] == b"ftyp":
        return "MP4"
    if data.startswith(HEADER_GUID):
        return "WMV"
    if data[:4] == b"fLaC":
        return "FLAC"
    if data[:3] == b"ID3":
        end = 10 + sync_safe(data[6:10]) if len(data) >= 10 else 0
        return "FLAC" if end and data[end : end + 4] == b"fLaC" else "MP3"
    if data[:4] == b"STRM" or low.endswith(STREAM_NAMES):
        return "Stream"
    if low.endswith((".mov", ".m4v")):
        return "MP4"
    if len(data) >= 2 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0 or data[-128:][:3] == b"TAG":
        return "MP3"
    return "MP3" if data[:4] in (b"SRSF", b"SRST") else None


def walk_riff(data: bytes, lean: bool, at: int = 0, end: int | None = None) -> Iterator[Span]:
    """Chunks of tracks are named by two digits and two letters; records stand at the start of the movi list."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        name, size = data[at : at + 4], u32(data, at + 4)
        if name in (b"RIFF", b"LIST"):
            yield Span(at, min(at + 12, end))
            if data[at + 8 : at + 12] == b"movi":
                yield INJECT
            if lean:  # sizes of lists count payloads that aren't there
                at += 12
                continue
            stop = min(at + 8 + size, end)
            yield from walk_riff(data, lean, at + 12, stop)
        elif name in (b"SRSF", b"SRST", b"SRSP"):
            at, stop = at + 8 + size + size % 2, at
            yield Span(stop, at, record=name.decode())
            continue
        elif re.fullmatch(rb"[0-9]{2}[A-Za-z]{2}", name):
            yield Span(at, at + 8)
            stop = at + 8 + (0 if lean else min(size, end - at - 8))
            yield Span(at + 8, stop, int(name[:2]), size)
        else:
            stop = min(at + 8 + size, end)
            yield Span(at, stop)
        if size % 2 and stop < end and (not lean or data[stop : stop + 1] == b"\0"):
            yield Span(stop, stop + 1)
            stop += 1
        at = stop
    if at < end:
        yield Span(at, end)


def walk_ebml(data: bytes, lean: bool, at: int = 0, end: int | None = None) -> Iterator[Span]:
    """Frame data of blocks is payload; records stand at the start of the segment."""
    end = len(data) if end is None else end
    while at < end:
        found = vint(data, at, keep_marker=True)
        sized = vint(data, at + found[1]) if found else None
        if not found or not sized:
            break
        kind, body = found[0], at + found[1] + sized[1]
        unknown = sized[0] == (1 << (7 * sized[1])) - 1
        stop = end if unknown else min(body + sized[0], end)
        if kind == EBML_RECORDS:
            yield Span(at, body)
            p = body
            while p < stop and (i := vint(data, p, keep_marker=True)) and (s := vint(data, p + i[1])):
                yield Span(p, p + i[1] + s[1] + s[0], record={EBML_FILE_RECORD: "SRSF", EBML_TRACK_RECORD: "SRST"}.get(i[0], "SRSP"))
                p += i[1] + s[1] + s[0]
        elif kind in CONTAINERS:
            yield Span(at, body)
            if kind == EBML_SEGMENT:
                yield INJECT
            if lean and kind in (EBML_SEGMENT, EBML_CLUSTER, EBML_GROUP):
                at = body
                continue
            yield from walk_ebml(data, lean, body, stop)
        elif kind in (EBML_BLOCK, EBML_SIMPLE) and (track := vint(data, body)):
            head = body + track[1] + 3
            lace = data[head - 1] & 6 if head <= len(data) else 0
            if lace:
                head += lace_sizes(data[head : head + 65_536], lace, sized[0] - (head - body))[1]
            size = max(sized[0] - (head - body), 0)
            stop = head if lean else min(head + size, end)
            yield Span(at, head)
            yield Span(head, stop, track[0], size)
        else:
            yield Span(at, stop)
        at = stop
    if at < end:
        yield Span(at, end)


def walk_mp4(data: bytes, lean: bool) -> Iterator[Span]:
    """The data of mdat is one track; records stand before it."""
    at = 0
    while at + 8 <= len(data):
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= len(data):
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = len(data) - at if size == 0 else size
        if size < head:
            break
        stop = min(at + size, len(data))
        if name in (b"SRSF", b"SRST", b"SRSP"):
            yield Span(at, stop, record=name.decode())
        elif name == b"mdat":
            yield INJECT
            stop = at + head if lean else stop
            yield Span(at, at + head)
            yield Span(at + head, stop, 1, size - head)
        else:
            yield Span(at, stop)
        at = stop
    if at < len(data):
        yield Span(at, len(data))


def walk_asf(data: bytes, lean: bool) -> Iterator[Span]:
    """The packets of the data object are one track; records stand behind it."""
    at = 0
    while at + 24 <= len(data):
        size = u64(data, at + 16)
        if size < 24:
            break
        stop, guid = min(at + size, len(data)), data[at : at + 16]
        if guid in (ASF_FILE, ASF_TRACK, ASF_PAD):
            yield Span(at, stop, record={ASF_FILE: "SRSF", ASF_TRACK: "SRST"}.get(guid, "SRSP"))
        elif guid == DATA_GUID and size >= 50:
            yield Span(at, at + 50)
            packets = u64(data, at + 40)
            whole = (size - 50) // packets * packets if packets else 0
            stop = at + 50 if lean else min(at + 50 + whole, len(data))
            yield Span(at + 50, stop, 1, whole)
            yield INJECT
            rest = size - 50 - whole
            if rest and not lean:
                yield Span(stop, stop + rest)
                stop += rest
        else:
            yield Span(at, stop)
        at = stop
    if at < len(data):
        yield Span(at, len(data))


def walk_flac(data: bytes, lean: bool) -> Iterator[Span]:
    """All behind the last metadata block is one track; records are blocks behind the marker."""
    at = 10 + sync_safe(data[6:10]) if data[:3] == b"ID3" else 0
    yield Span(0, at + 4)
    yield INJECT
    at += 4
    last = False
    while not last and at + 4 <= len(data):
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last = bool(data[at] & 0x80)
        stop = min(at + 4 + size, len(data))
        yield Span(at, stop, record={0x73: "SRSF", 0x74: "SRST", 0x75: "SRSP"}.get(kind))
        at = stop
    yield Span(at, len(data), 1, len(data) - at)


def audio_bounds(data: bytes) -> tuple[int, int]:
    """Where the audio of an MP3 starts, behind stacked ID3v2 tags, and ends, before ID3v1, Lyrics3 and APE tags."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data):
        start += 10 + sync_safe(data[start + 6 : start + 10])
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if data[end - 9 : end] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
        end -= int(data[end - 15 : end - 9]) + 15
    elif data[end - 9 : end] == b"LYRICSEND":
        begun = data.rfind(b"LYRICSBEGIN", max(0, end - 5100), end)
        end = begun if begun >= 0 else end
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = u32(data, end - 20) + (32 if u32(data, end - 12) & 0x80000000 else 0)
        end -= size if size <= end else 0
    return min(start, end), end


def walk_blocks(data: bytes, at: int) -> Iterator[Span]:
    """Records of eight bytes and their payload, as MP3 and stream skeletons hold them."""
    while at + 8 <= len(data) and data[at : at + 4] in (b"SRSF", b"SRST", b"SRSP", b"STRM"):
        size = max(u32(data, at + 4), 8)
        yield Span(at, at + size, record=data[at : at + 4].decode())
        at += size


def walk_mp3(data: bytes, lean: bool) -> Iterator[Span]:
    """The audio is one track; records stand in its place."""
    start, end = audio_bounds(data)
    if start:
        yield Span(0, start)
    yield INJECT
    if lean:
        records = list(walk_blocks(data, start))
        yield from records
        at = records[-1].end if records else start
        yield Span(at, at, 1, 0)
        if at < len(data):
            yield Span(at, len(data))
        return
    yield Span(start, end, 1, end - start)
    if end < len(data):
        yield Span(end, len(data))


def walk_stream(data: bytes, lean: bool) -> Iterator[Span]:
    """The whole file is one track."""
    yield INJECT
    if lean:
        yield from walk_blocks(data, 0)
    yield Span(0, 0 if lean else len(data), 1, 0 if lean else len(data))


WALKS = {"AVI": walk_riff, "MKV": walk_ebml, "MP4": walk_mp4, "WMV": walk_asf, "FLAC": walk_flac, "MP3": walk_mp3, "Stream": walk_stream}


def signature_size(content: bytes, held: int) -> int:
    """Bytes to add to a Matroska signature: one step, or more while the ends of steps are ASCII."""
    n = 1
    while n <= STEPS and content[SIGNATURE * n - held - WINDOW : SIGNATURE * n - held].isascii():
        n += 1
    return (SIGNATURE if n >= STEPS else SIGNATURE * n) - held


def profile(data: bytes, kind: str) -> dict:
    """Tracks (track_no, data_length, signature), CRC-32 and size of a sample."""
    if kind == "MP4" and len([s for s in walk_mp4(data, False) if s.track]) > 1:
        raise ValueError("several mdat atoms aren't supported")
    lengths: dict[int, int] = {}
    signs: dict[int, bytes] = {}
    for s in WALKS[kind](data, False):
        if s.track is None or s == INJECT:
            continue
        held = signs.get(s.track, b"")
        lengths[s.track] = lengths.get(s.track, 0) + s.end - s.start
        if len(held) < SIGNATURE:
            piece = data[s.start : s.end]
            take = signature_size(piece, len(held)) if kind == "MKV" else SIGNATURE - len(held)
            signs[s.track] = held + piece[:take]
    tracks = [{"track_no": t, "data_length": n, "signature": signs.get(t, b""), "match_offset": 0} for t, n in lengths.items() if n or kind == "Stream"]
    return {"kind": kind, "size": len(data), "crc": zlib.crc32(data), "tracks": tracks}


def file_record(name: str, size: int, crc: int, app: str = "quarry") -> bytes:
    a, n = app.encode(), name.rsplit("/", 1)[-1].encode()
    return struct.pack("<HH", 3, len(a)) + a + struct.pack("<H", len(n)) + n + struct.pack("<QI", size, crc)


def track_record(track: dict, big: bool) -> bytes:
    wide = track["track_no"] >= 0x10000
    head = struct.pack("<H", (4 if big else 0) | (8 if wide else 0)) + struct.pack("<I" if wide else "<H", track["track_no"])
    return head + struct.pack("<Q" if big else "<I", track["data_length"]) + struct.pack("<QH", track["match_offset"], len(track["signature"])) + track["signature"]


def framed(kind: str, name: str, payload: bytes) -> bytes:
    """A record in the frame of its container."""
    tag = name.encode()
    if kind == "AVI":
        return tag + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    if kind == "MP4":
        return struct.pack(">I", len(payload) + 8) + tag + payload
    if kind == "WMV":
        return (ASF_FILE if name == "SRSF" else ASF_TRACK) + struct.pack("<Q", len(payload) + 24) + payload
    if kind == "FLAC":
        return bytes([0x73 if name == "SRSF" else 0x74]) + len(payload).to_bytes(3, "big") + payload
    if kind == "MKV":
        return id_bytes(EBML_FILE_RECORD if name == "SRSF" else EBML_TRACK_RECORD) + to_vint(len(payload)) + payload
    return tag + struct.pack("<I", len(payload) + 8) + payload


def records(kind: str, name: str, facts: dict) -> bytes:
    big = facts["size"] >= BIG
    out = framed(kind, "SRSF", file_record(name, facts["size"], facts["crc"])) + b"".join(framed(kind, "SRST", track_record(t, big)) for t in facts["tracks"])
    if kind == "MKV":
        return id_bytes(EBML_RECORDS) + to_vint(len(out)) + out
    return (b"STRM" + struct.pack("<I", 8) if kind == "Stream" else b"") + out


def make_skeleton(data: bytes, kind: str, name: str, facts: dict | None = None) -> bytes:
    """The sample without its payloads, with the records that tell them."""
    facts = facts or profile(data, kind)
    out, done = [], False
    for s in WALKS[kind](data, False):
        if s == INJECT:
            if not done:
                out.append(records(kind, name, facts))
            done = True
        elif s.track is None:
            out.append(data[s.start : s.end])
    return b"".join(out)


def parse_record(kind: str, span: Span, data: bytes) -> dict:
    """Fields of a record."""
    raw = data[span.start : span.end]
    if kind == "MKV":
        i = vint(raw, 0, keep_marker=True)
        raw = raw[i[1] + vint(raw, i[1])[1] :]
    else:
        raw = raw[{"WMV": 24, "FLAC": 4}.get(kind, 8) :]
    if span.record == "SRSF":
        flags, a = struct.unpack_from("<HH", raw)
        n = struct.unpack_from("<H", raw, 4 + a)[0]
        size, crc = struct.unpack_from("<QI", raw, 6 + a + n)
        return {"flags": flags, "app": raw[4 : 4 + a].decode("utf-8", "replace"), "name": raw[6 + a : 6 + a + n].decode("utf-8", "replace"), "size": size, "crc": crc}
    flags = struct.unpack_from("<H", raw)[0]
    form = "<" + ("I" if flags & 8 else "H") + ("Q" if flags & 4 else "I") + "QH"
    track, length, offset, n = struct.unpack_from(form, raw, 2)
    at = 2 + struct.calcsize(form)
    return {"flags": flags, "track_no": track, "data_length": length, "match_offset": offset, "signature": raw[at : at + n]}


def parse_skeleton(data: bytes, name: str = "") -> dict:
    """{kind, file, tracks}: what a skeleton tells; of repeated track numbers the last counts."""
    kind = sniff(data, name)
    if kind is None:
        raise ValueError("not a media skeleton")
    file, tracks = None, {}
    for s in WALKS[kind](data, True):
        if s.record == "SRSF":
            file = parse_record(kind, s, data)
        elif s.record == "SRST":
            t = parse_record(kind, s, data)
            tracks[t["track_no"]] = t
    return {"kind": kind, "file": file, "tracks": list(tracks.values())}


def track_payload(media: bytes, kind: str, track: int) -> Iterator[Span]:
    """The payload spans of a track in full media; the whole file for kinds that don't interleave."""
    if kind in ("AVI", "MKV"):
        yield from (s for s in WALKS[kind](media, False) if s.track == track)
    else:
        yield Span(0, len(media), track, len(media))


def locate(media: bytes, kind: str, track: dict) -> int:
    """Offset of a track's signature: at its hint, near it, then anywhere; it may run over several frames.  -1 if nowhere."""
    sign, hint = track["signature"], track["match_offset"]
    if hint and media[hint : hint + len(sign)] == sign:
        return hint
    if hint:
        low = max(0, hint - RADIUS)
        at = media.find(sign, low, hint + RADIUS + len(sign))
        if at >= 0:
            return at
    if kind not in ("AVI", "MKV"):
        return media.find(sign)
    spans = list(track_payload(media, kind, track["track_no"]))
    joined = b"".join(media[s.start : s.end] for s in spans)
    at = joined.find(sign)
    for s in spans if at >= 0 else []:
        if at < s.end - s.start:
            return s.start + at
        at -= s.end - s.start
    return -1


def take(media: bytes, kind: str, track: dict, offset: int) -> bytes:
    """A track's bytes from an offset of the media, over as many frames as it needs."""
    need, out = track["data_length"], []
    for s in track_payload(media, kind, track["track_no"]):
        if need and s.end > offset:
            piece = media[max(s.start, offset) : s.end][:need]
            out.append(piece)
            need -= len(piece)
    return b"".join(out)


def rebuild(skeleton: bytes, media: bytes, name: str = "") -> dict:
    """{data, crc_ok, size_ok}: the sample, from its skeleton and the media that it was cut from.

    The CRC may be stored in either byte order.
    """
    facts = parse_skeleton(skeleton, name)
    kind, file = facts["kind"], facts["file"]
    pools: dict[int, bytes] = {}
    for t in facts["tracks"]:
        at = locate(media, kind, t)
        if at < 0:
            raise ValueError(f"track {t['track_no']} isn't in the media")
        pools[t["track_no"]] = take(media, kind, t, at)
    used = dict.fromkeys(pools, 0)
    out = []
    for s in WALKS[kind](skeleton, True):
        if s == INJECT or s.record:
            continue
        if s.track is None:
            piece = skeleton[s.start : s.end]
            if kind == "MKV" and piece.startswith(id_bytes(EBML_RECORDS)):
                continue
            out.append(piece)
        elif s.track in pools:
            n = s.size if kind in ("AVI", "MKV") else len(pools[s.track])
            out.append(pools[s.track][used[s.track] : used[s.track] + n])
            used[s.track] += n
    data = b"".join(out)
    crc = zlib.crc32(data)
    swapped = int.from_bytes(crc.to_bytes(4, "little"), "big")
    return {"data": data, "crc_ok": file is not None and file["crc"] in (crc, swapped), "size_ok": file is not None and file["size"] == len(data)}


def ebml_nodes(data: bytes, cap: int = 1000) -> Iterator[dict]:
    """Elements as (node_id, parent_id, element_id, pos, header_size, data_size, ordinal); a last row tells a cut."""
    todo, n = [(0, len(data), None)], 0
    while todo:
        at, end, parent = todo.pop()
        ordinal = 0
        while at < end:
            i = vint(data, at, keep_marker=True)
            s = vint(data, at + i[1]) if i else None
            if not i or not s:
                break
            if n >= cap:
                yield {"node_id": n, "parent_id": None, "element_id": None, "pos": at, "header_size": 0, "data_size": len(data) - at, "ordinal": 0}
                return
            body = at + i[1] + s[1]
            unknown = s[0] == (1 << (7 * s[1])) - 1
            stop = end if unknown else min(body + s[0], end)
            yield {"node_id": n, "parent_id": parent, "element_id": i[0], "pos": at, "header_size": i[1] + s[1], "data_size": stop - body, "ordinal": ordinal}
            if i[0] in CONTAINERS:
                todo.append((body, stop, n))
            n, ordinal, at = n + 1, ordinal + 1, stop


def children(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, body) of the elements that a body holds, up to the first that doesn't fit."""
    at = 0
    while (i := vint(data, at, keep_marker=True)) and (s := vint(data, at + i[1])) and (body := at + i[1] + s[1]) + s[0] <= len(data):
        yield i[0], data[body : body + s[0]]
        at = body + s[0]


#: Elements of a track's content encodings.
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
HEADER_STRIPPING = 3


def stripped_header(track: bytes) -> bytes | None:
    """The bytes that header stripping took off each frame of a track (the children of its entry); None without it."""
    for kind, encodings in children(track):
        for k, encoding in children(encodings) if kind == ENCODINGS else ():
            for c, compression in children(encoding) if k == ENCODING else ():
                parts = dict(children(compression)) if c == COMPRESSION else {}
                if ALGORITHM in parts and int.from_bytes(parts[ALGORITHM], "big") == HEADER_STRIPPING and SETTINGS in parts:
                    return parts[SETTINGS]
    return None


def restored_frame(header: bytes | None, frame: bytes) -> bytes:
    return (header or b"") + frame


def ebml_number(kind: str, body: bytes) -> int | float | None:
    """Value of an uint, int or float element; None for a size that the kind doesn't have."""
    if kind == "float":
        return 0.0 if not body else struct.unpack(">f" if len(body) == 4 else ">d", body)[0] if len(body) in (4, 8) else None
    return int.from_bytes(body, "big", signed=kind == "int") if len(body) <= 8 else None


#: Bytes beyond which an element's value isn't read, and bytes shown of a binary one.
LEAF_BYTES, SHOWN_BYTES = 1 << 20, 16


def ebml_text(kind: str, body: bytes) -> str:
    """Shown value of an element of kind uint, int, float, date, text or binary; sizes that a kind doesn't have show as binary."""
    if not body:
        return {"uint": "0", "int": "0", "binary": "0 bytes"}.get(kind, "")
    if len(body) > LEAF_BYTES:
        return f"{len(body):,} bytes"
    if kind == "text":
        return body.decode("utf-8", "replace").rstrip("\0")
    if kind == "date" and len(body) <= 8:
        nanos = int.from_bytes(body, "big", signed=True)
        try:
            at = dt.datetime(2001, 1, 1) + dt.timedelta(seconds=nanos // 10**9)
        except OverflowError:
            return f"{nanos} ns (out of range)"
        return at.strftime("%Y-%m-%d %H:%M:%S UTC")
    if kind in ("uint", "int", "float") and (value := ebml_number(kind, body)) is not None:
        shortest = str(np.float32(value) if len(body) == 4 and kind == "float" else value)
        return shortest.removesuffix(".0").upper() if np.isfinite(value) else shortest
    return f"{len(body)} bytes: {body[:SHOWN_BYTES].hex(' ').upper()}" + (" …" if len(body) > SHOWN_BYTES else "")
