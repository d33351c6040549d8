"""Chains, entries over volumes, detailed fields, discs and streams."""

import struct

from quarry.operators import chains
from quarry.sources import readers
from quarry.sources.codecs import archive, disc, fields
from quarry.streaming import ingest


def test_ordered_chains(spark):
    lines = [("m", 0, "b.rar"), ("m", 1, "a.rar"), ("m", 2, "b.r00"), ("m", 3, "note.txt"), ("m", 4, "a.r00")]
    rows = spark.createDataFrame(lines, "manifest string, line_no int, name string")
    got = sorted((r["chain_no"], r["position"], r["name"]) for r in chains.ordered_chains(rows).collect())
    assert got == [(0, 0, "b.rar"), (0, 1, "b.r00"), (1, 0, "a.rar"), (1, 1, "a.r00")]


def ordered(df):
    return [r["name"] for r in df.orderBy("position").collect()]


def test_orders(spark):
    old = spark.createDataFrame([("s", n) for n in ("a.s00", "a.r01", "a.rar", "a.r00", "a.txt")], "g string, name string")
    assert ordered(chains.natural_order(old, ["g"])) == ["a.rar", "a.r00", "a.r01", "a.s00", "a.txt"]
    assert ordered(chains.on_disk_order(old, ["g"])) == ["a.rar", "a.r00", "a.r01", "a.s00"]
    new = spark.createDataFrame([("s", n) for n in ("a.part2.rar", "a.part10.rar", "a.rar")], "g string, name string")
    assert ordered(chains.natural_order(new, ["g"]))[1:] == ["a.part2.rar", "a.part10.rar"]
    assert ordered(chains.on_disk_order(new, ["g"])) == ["a.part10.rar", "a.part2.rar"]


def test_entries_over_volumes(spark):
    import zlib

    data = bytes(range(256)) * 3
    crc = zlib.crc32(data)
    v1 = archive.volume4([archive.file4("f.bin", data[:500], archive.SPLIT_AFTER, unpacked=len(data), crc=1), archive.file4("bad.bin", b"x", crc=5)])
    v2 = archive.volume4([archive.file4("F.bin", data[500:], archive.SPLIT_BEFORE, unpacked=len(data), crc=crc)])
    content = spark.createDataFrame([("a.rar", bytearray(v1)), ("a.r00", bytearray(v2))], "path string, content binary")
    volumes = spark.createDataFrame([("a.rar", "a", 0), ("a.r00", "a", 1)], "path string, set_key string, position int")
    got = {r["name"]: r for r in chains.read_entries(readers.blocks(content), volumes, content).collect()}
    assert bytes(got["f.bin"]["data"]) == data and got["f.bin"]["skip_reason"] is None
    assert got["bad.bin"]["skip_reason"] == "checksum differs" and got["bad.bin"]["data"] is None
    half = volumes.where("position = 0")
    assert {r["name"]: r["skip_reason"] for r in chains.read_entries(readers.blocks(content), half, content).collect()}["f.bin"] == "volumes missing"


def test_plans(spark):
    p = spark.createDataFrame([("x", 0, "o1"), ("x", 1, "o2"), ("y", 0, "o3")], "g string, position int, name string")
    e = spark.createDataFrame([("x", 0, "n1"), ("x", 1, "n2"), ("y", 0, "n3"), ("y", 1, "n4")], "g string, position int, name string")
    assert sorted((r["source"], r["dest"]) for r in chains.rename_plan(p, e, ["g"]).collect()) == [("o1", "n1"), ("o2", "n2")]
    wanted = spark.createDataFrame([("CD1\\a.bin",), ("b.bin",), ("none",)], "name string")
    present = spark.createDataFrame([("CD1/a.bin",), ("a.bin",), ("x/B.BIN",)], "path string")
    assert {r["name"]: r["path"] for r in chains.source_files(wanted, present).collect()} == {"CD1\\a.bin": "CD1/a.bin", "b.bin": "x/B.BIN", "none": None}


def test_languages(spark):
    rows = spark.createDataFrame([("s", "b.idx", bytearray(b"x\r\nid: en, index: 0\r\n")), ("s", "A.IDX", bytearray(b"id: fr\n")), ("s", "c.txt", bytearray(b"id: no"))], "set_key string, name string, data binary")
    assert chains.languages_diz(rows).first()["text"] == "id: fr\nid: en, index: 0\n"


def test_header_fields(spark):
    data = archive.volume4([archive.file4("a.txt", b"hello", archive.SPLIT_AFTER)])
    made = list(fields.fields(data))
    by = {(f["block"], f["name"]): f for f in made}
    assert by["File Header", "File Name"]["value"] == "a.txt"
    assert by["File Header", "SPLIT_AFTER"]["value"] == "set" and by["File Header", "LARGE"]["value"] == "unset"
    assert by["File Header", "Method"]["description"] == "Store" and by["File Header", "Header CRC"]["description"] == "valid"
    assert all(data[f["offset"] : f["offset"] + f["length"]] == f["raw"] for f in made)
    five = {(f["block"], f["name"]): f for f in fields.fields(archive.volume5([archive.file5("b", b"yy")]))}
    assert five["File Header", "Name"]["value"] == "b" and five["File Header", "Unpacked Size"]["value"] == "2"
    rows = spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(b"no"))], "path string, content binary")
    assert readers.header_fields(rows).count() == len(made)


def image(files):
    """A small disc image with one folder of files."""
    record = lambda name, place, size, flags: struct.pack("<BBIIII7sBBBHHB", 33 + len(name) + (1 - len(name) % 2), 0, place, 0, size, 0, bytes(7), flags, 0, 0, 1, 0, len(name)) + name + bytes(1 - len(name) % 2)
    place, body, listing = 20, b"", record(b"\0", 19, 2048, 2) + record(b"\1", 18, 2048, 2)
    for name, data in files:
        listing += record(name.encode() + b";1", place, len(data), 0)
        body += data.ljust(-(-len(data) // 2048) * 2048, b"\0")
        place += -(-len(data) // 2048)
    root = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"VIDEO_TS", 19, 2048, 2)
    head = bytearray(2048)
    head[:6] = b"\x01CD001"
    head[156:190] = record(b"\0", 18, 2048, 2)[:34]
    return bytes(16 * 2048) + bytes(head) + bytes(2048) + root.ljust(2048, b"\0") + listing.ljust(2048, b"\0") + body


def test_disc(spark):
    data = image([("VTS_01_1.VOB", b"a" * 3000 + b"SIG"), ("VTS_01_2.VOB", b"NATURE" + b"b" * 10), ("VTS_02_1.VOB", b"c"), ("READ.ME", b"d")])
    assert [e["name"] for e in disc.media_files(data)] == ["VIDEO_TS/VTS_01_1.VOB", "VIDEO_TS/VTS_01_2.VOB", "VIDEO_TS/VTS_02_1.VOB"]
    assert list(disc.title_sets(data)) == ["VTS_01", "VTS_02"]
    assert disc.matching_set(data, b"SIGNATURE") == ("VTS_01", 3000)
    assert disc.matching_set(data, b"nowhere") is None
    rows = spark.createDataFrame([("d.iso", bytearray(data)), ("e.iso", bytearray(b""))], "path string, content binary")
    assert [r["size"] for r in readers.disc_files(rows).orderBy("name").collect()] == [3003, 16, 1]


def test_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.into(ingest.arriving(spark, str(tmp_path / "in")), readers.blocks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    for k in range(2):
        (tmp_path / "in" / f"{k}.rar").write_bytes(archive.volume4([archive.file4(f"f{k}", b"x")]))
        run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["name"] for r in out.where("name is not null").collect()) == ["f0", "f1"]


def test_signature_over_batches(spark, tmp_path):
    schema = "track long, offset long, data binary"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in [[(1, 0, b"..SI"), (2, 0, b"none")], [(1, 4, b"GNAL.."), (2, 4, b"....")], [(1, 10, b"SIGNAL")]]:
        spark.createDataFrame([(t, o, bytearray(d)) for t, o, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.find_in_chunks(stream, b"SIGNAL").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r["track"], r["found"]) for r in spark.read.schema("track long, found long").parquet(str(tmp_path / "out")).collect()] == [(1, 2)]


def test_names_of_first_files():
    volume = archive.volume4([archive.file4("dir/a.bin", b"xyz")])
    assert archive.first_name(volume) == "dir\\a.bin"
    assert archive.first_name(archive.volume5([archive.file5("b.bin", b"")])) == "b.bin"
    assert archive.first_name(b"stub" + volume) is None and archive.first_name(archive.volume4([])) is None and archive.first_name(b"") is None


def test_end_blocks_hold_the_checksum_of_all_before():
    import struct
    import zlib

    head = archive.MARK4 + archive.simple4(archive.ARCHIVE, 0, bytes(6)) + archive.file4("a", b"data")
    volume = head + archive.simple4(archive.END, archive.DATA_CRC, struct.pack("<I", zlib.crc32(head)))
    made = archive.patch4(volume, host=3)
    end = len(head)
    assert made[:end] != head and struct.unpack_from("<I", made, end + 7)[0] == zlib.crc32(made[:end])
    assert all(b["crc_valid"] for b in archive.volume_blocks(made)) and archive.patch_end(volume) == volume
    plain = archive.volume4([archive.file4("a", b"data")])
    assert archive.patch_end(plain) == plain


def test_header_stripping():
    """Bytes written by hand: a track entry with a codec id and encodings of algorithm 3."""
    from quarry.sources.codecs import media

    stripped = bytes.fromhex("42 55 83 00 00 01".replace(" ", ""))
    compression = bytes.fromhex("50 34".replace(" ", "")) + bytes([0x80 | 10]) + bytes.fromhex("42548103") + stripped
    encoding = bytes.fromhex("6240") + bytes([0x80 | len(compression)]) + compression
    track = bytes.fromhex("d78101") + bytes.fromhex("6d80") + bytes([0x80 | len(encoding)]) + encoding
    assert media.stripped_header(track) == b"\0\0\1"
    assert media.restored_frame(media.stripped_header(track), b"x") == b"\0\0\1x"
    assert media.stripped_header(bytes.fromhex("d78101")) is None and media.stripped_header(track[:-1]) is None
    assert media.stripped_header(track.replace(bytes.fromhex("42548103"), bytes.fromhex("42548100"))) is None


def test_numbers_of_elements():
    from quarry.sources.codecs import media

    assert [media.ebml_number(k, bytes.fromhex(v)) for k, v in (("uint", ""), ("uint", "ff"), ("int", "ff"), ("int", "8000"), ("float", "3f800000"), ("float", "4000000000000000"), ("float", ""), ("float", "00"), ("uint", "00" * 9))] == [0, 255, -1, -32768, 1.0, 2.0, 0.0, None, None]


def test_menus_are_in_no_title_set(monkeypatch):
    """A signature over the border of two files and of two reads is found once, in its set."""
    files = [("VIDEO_TS/VIDEO_TS.VOB", 0, 4), ("VIDEO_TS/VTS_01_1.VOB", 4, 5), ("VIDEO_TS/VTS_01_2.VOB", 9, 5), ("a.MOV", 14, 1)]
    data = b"SIGNxxxxSIGNyyz"
    monkeypatch.setattr(disc, "entries", lambda _: ({"name": n, "offset": o, "size": s} for n, o, s in files))
    assert [e["name"] for e in disc.media_files(data)][0] == "a.MOV" and list(disc.title_sets(data)) == ["VTS_01"]
    for size in (1, 2, 3, 100):
        monkeypatch.setattr(disc, "BUFFER", size)
        assert disc.matching_set(data, b"SIGN") == ("VTS_01", 4) and disc.matching_set(data, b"SIGNx") is None


def test_packers_hashes_and_names_that_are_missing(spark):
    import pytest
    from pyspark.sql import functions as F

    from quarry.functions import scalars
    from quarry.operators import edit

    df = spark.createDataFrame([("18446744073709551615", 0x100, False), ("4294967295", 0, False), ("4294967295", 0x100, False), ("4294967295", 0, True), ("5", 0, False), (None, 0, False)], "n string, flags long, is_dir boolean")
    got = [r[0] for r in df.select(scalars.custom_packer(F.col("n").cast("decimal(20,0)"), F.col("flags"), F.col("is_dir"))).collect()]
    assert got == ["all ones, large", "all ones, 32 bits", None, None, None, None]
    sums = spark.createDataFrame([("ABCD",), (" abcd",), ("00",), (None,)], "d string")
    assert [r[0] for r in sums.select(scalars.known_hash(F.col("d"), ["abcD "])).collect()] == [True, True, False, False]
    stored = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "g int, ord int, name string")
    change = lambda *rows: edit.rename(stored, spark.createDataFrame(list(rows), "g int, old string, new string"), ["g"])
    assert sorted(tuple(r) for r in change((1, "B", "c")).collect()) == [(1, 0, "a"), (1, 1, "c"), (2, 0, "a")]
    with pytest.raises(Exception, match="no stored name: zz"):
        change((2, "zz", "c")).collect()
