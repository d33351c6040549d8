"""Codecs against hand-made bytes: layouts, golden values, round trips, broken input."""

import struct
import zlib

import pytest

from quarry.sources.codecs import archive, bits, media


@pytest.mark.parametrize(("value", "code"), [(0, "80"), (126, "fe"), (127, "407f"), (16382, "7ffe"), (16383, "203fff")])
def test_vint(value, code):
    assert bits.to_vint(value).hex() == code
    assert bits.vint(bytes.fromhex(code), 0) == (value, len(code) // 2)


def test_vint_cut_off():
    assert bits.vint(b"\x40", 0) is None
    assert bits.vint(b"\x00", 0) is None


@pytest.mark.parametrize(("value", "code"), [(128, "00000100"), (257, "00000201"), (268435455, "7f7f7f7f")])
def test_sync_safe(value, code):
    assert bits.sync_safe(bytes.fromhex(code)) == value
    assert bits.to_sync_safe(value).hex() == code


def test_dos_time():
    assert bits.dos_time(0) is None
    assert bits.dos_time((44 << 25) | (2 << 21) | (29 << 16) | (12 << 11)).isoformat() == "2024-02-29T12:00:00"
    assert bits.dos_time((44 << 25) | (13 << 21) | (1 << 16)) is None


@pytest.mark.parametrize(("kind", "data", "total", "sizes", "used"), [
    (0, b"", 10, [10], 0),
    (4, b"\x01" + bytes(8), 9, [4, 4], 1),
    (2, b"\x01\xff\x01" + bytes(300), 303, [256, 44], 3),
    (6, b"\x02\x83\xc0" + bytes(12), 15, [3, 4, 5], 3),
])
def test_lacing(kind, data, total, sizes, used):
    assert bits.lace_sizes(data, kind, total) == (sizes, used)


def test_volume_of_format_4():
    data = archive.volume4([archive.file4("a.txt", b"hello", archive.SPLIT_AFTER)], flags=0x101)
    found = list(archive.volume_blocks(data))
    assert [b["type"] for b in found] == [archive.ARCHIVE, archive.FILE, archive.END]
    assert all(b["crc_valid"] for b in found)
    f = found[1]
    assert (f["name"], f["add_size"], f["method"], f["host_os"], f["split_after"], f["is_dir"]) == ("a.txt", 5, 0, 2, True, False)
    assert f["file_crc"] == zlib.crc32(b"hello")
    assert f["mtime"] == bits.dos_time(0x5A8E3100)


def test_volume_of_format_5():
    data = archive.volume5([archive.file5("ä.txt", b"hello", 8)])
    found = list(archive.volume_blocks(data))
    assert [b["type"] for b in found] == [1, 2, 5]
    assert all(b["crc_valid"] for b in found)
    assert (found[1]["name"], found[1]["split_before"], found[1]["unpacked_size"], found[1]["dict_kb"]) == ("ä.txt", True, 5, 128)


def test_marker_behind_a_stub():
    data = bytes(1000) + archive.volume4([archive.file4("a", b"x")])
    assert archive.marker(data) == (4, 1007)
    assert archive.marker(b"nothing") == (0, 0)


def test_broken_volume_ends_quietly():
    data = archive.volume4([archive.file4("a", b"x" * 50)])
    assert [b["type"] for b in archive.volume_blocks(data[:25])] == [archive.ARCHIVE]
    bad = bytearray(data)
    bad[10] ^= 1
    assert not next(archive.volume_blocks(bytes(bad)))["crc_valid"]


def test_large_flag_round_trip():
    data = archive.volume4([archive.file4("a", b"x" * 50), archive.file4("b", b"yy")])
    more = archive.patch_large(data, True)
    assert len(more) == len(data) + 16
    assert all(b["crc_valid"] for b in archive.volume_blocks(more))
    assert archive.patch_large(more, False) == data


def test_patch_changes_what_it_says():
    data = archive.patch4(archive.volume4([archive.file4("a", b"x")]), host=3, attributes=0x81A4, mtimes={"a": 1 << 25 | 1 << 21 | 1 << 16})
    f = list(archive.volume_blocks(data))[1]
    assert (f["host_os"], f["attributes"], f["mtime"].year, f["crc_valid"]) == (3, 0x81A4, 1981, True)


@pytest.mark.parametrize("form", [4, 5])
def test_skeleton_and_rebuilt_volumes(form):
    payload = bytes(range(256)) * 4
    make, file = (archive.volume4, archive.file4) if form == 4 else (archive.volume5, archive.file5)
    volumes = [("r.rar", make([file("m.mkv", payload[:600])])), ("r.r00", make([file("m.mkv", payload[600:])]))]
    skeleton = archive.make_skeleton(volumes, [("r.nfo", b"info")], app="test")
    found = list(archive.skeleton_blocks(skeleton))
    assert [b["name"] for b in found if b["format"] == 0] == ["test", "r.nfo", "r.rar", "r.r00"]
    assert archive.rebuild_volumes(skeleton, {"m.mkv": payload}) == dict(volumes)
    with pytest.raises(ValueError, match="ends early"):
        archive.rebuild_volumes(skeleton, {"m.mkv": payload[:700]})


def test_skeleton_breaks_off():
    skeleton = archive.make_skeleton([], [("r.nfo", b"info")])
    assert list(archive.skeleton_blocks(skeleton[:-2]))[-1]["error"] == "block overruns file"
    assert list(archive.skeleton_blocks(skeleton + b"1234567"))[-1]["error"] == "unknown block"
    assert list(archive.skeleton_blocks(b"")) == []


def test_oso_hash():
    assert archive.oso_hash(bytes(65_535)) is None
    data = b"\xff" * 131_072
    total = (len(data) + 2 * 8192 * (2**64 - 1)) % 2**64
    assert archive.oso_hash(data) == total.to_bytes(8, "little")


def samples():
    a, b = bytes(range(200, 256)) * 10, bytes(range(128, 230)) * 3
    chunk = lambda n, d: n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    movi = b"movi" + chunk(b"00dc", a[:301]) + chunk(b"01wb", b) + chunk(b"00dc", a[301:])
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(10))) + chunk(b"LIST", movi)
    avi = b"RIFF" + struct.pack("<I", len(body)) + body
    el = lambda i, d: bits.id_bytes(i) + bits.to_vint(len(d)) + d
    cluster = el(0x1F43B675, el(0xE7, b"\0") + el(0xA3, b"\x81\0\0\x80" + a) + el(0xA3, b"\x82\0\0\x80" + b) + el(0xA3, b"\x81\0\1\x80" + a))
    mkv = el(0x1A45DFA3, el(0x4282, b"matroska")) + el(0x18538067, el(0x1549A966, b"x") + cluster)
    mp4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 40) + b"moov" + bytes(32) + struct.pack(">I", 8 + len(a)) + b"mdat" + a
    asf = media.HEADER_GUID + bytes(8) + struct.pack("<Q", 32) + bytes(8) + media.DATA_GUID + struct.pack("<Q", 50 + len(a)) + bytes(16) + struct.pack("<Q", 2) + bytes(2) + a
    flac = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes(34) + a
    id3 = b"ID3\3\0\0" + bits.to_sync_safe(10) + bytes(10)
    mp3 = id3 + id3 + b"\xff\xfb" + a + b"TAG" + bytes(125)
    return {"AVI": avi, "MKV": mkv, "MP4": mp4, "WMV": asf, "FLAC": flac, "MP3": mp3, "Stream": a * 2}


@pytest.mark.parametrize("kind", list(media.WALKS))
def test_media_round_trip(kind):
    data = samples()[kind]
    name = "s.vob" if kind == "Stream" else "s.bin"
    assert media.sniff(data, name) == kind
    facts = media.profile(data, kind)
    assert (facts["crc"], facts["size"]) == (zlib.crc32(data), len(data))
    skeleton = media.make_skeleton(data, kind, name)
    assert len(skeleton) < len(data) + 900
    told = media.parse_skeleton(skeleton, name)
    assert told["kind"] == kind
    assert told["file"]["crc"] == zlib.crc32(data)
    assert [t["data_length"] for t in told["tracks"]] == [t["data_length"] for t in facts["tracks"]]
    made = media.rebuild(skeleton, data, name)
    assert made["data"] == data
    assert made["crc_ok"] and made["size_ok"]


def test_rebuild_needs_the_media():
    data = samples()["MP4"]
    with pytest.raises(ValueError, match="isn't in the media"):
        media.rebuild(media.make_skeleton(data, "MP4", "s"), data[:60] + bytes(len(data)))


def test_flac_behind_id3_is_flac():
    assert media.sniff(b"ID3\3\0\0" + bits.to_sync_safe(4) + bytes(4) + b"fLaC") == "FLAC"
    assert media.sniff(b"what") is None


def test_several_mdat_are_refused():
    data = samples()["MP4"] + struct.pack(">I", 12) + b"mdat1234"
    with pytest.raises(ValueError, match="mdat"):
        media.profile(data, "MP4")


def test_signature_grows_over_ascii():
    assert media.signature_size(bytes([200]) * 1000, 0) == 256
    assert media.signature_size(b"a" * 600 + bytes([200]) * 1000, 0) == 768
    assert media.signature_size(b"a" * 100_000, 0) == 256


def test_ebml_nodes_and_cap():
    nodes = list(media.ebml_nodes(samples()["MKV"]))
    assert [n["element_id"] for n in nodes if n["parent_id"] is None] == [0x1A45DFA3, 0x18538067]
    assert len(nodes) == 8
    assert list(media.ebml_nodes(samples()["MKV"], cap=3))[-1]["element_id"] is None


def test_unicode_name():
    packed = bytes([4, 0b01_00_00_00, 0x30, ord("b"), ord("c"), ord("d")])
    assert archive.unicode_name(b"abcd", packed)[0] == "а"
