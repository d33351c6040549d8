"""Column functions against golden values."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import names, scalars
from quarry.sources import manifests


def values(spark, column, inputs, kind="string"):
    """The column x -> column(x) over inputs, in order."""
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("fn", "cases"), [
    (names.next_old_volume, {"a.r99": "a.s00", "a.R99": "a.S00", "disc.099": "disc.100", "bar.rar": "bar.r00", "a.zzz": None, "x.RAR": "x.R00"}),
    (names.next_new_volume, {"foo.part09.rar": "foo.part10.rar", "foo.part99.rar": "foo.part100.rar", "foo.rar": None}),
    (names.base_name, {"The.Movie.Part.1.part01.rar": "The.Movie.Part.1", "release.001": "release", "x.PART2.RAR": "x"}),
    (names.set_key, {"DVD1\\aln-re4a.r28": "DVD1/aln-re4a", "rls.part002.rar": "rls", "/a/b.rar": "a/b"}),
    (names.canonical, {"CD1\\a.sfv": "CD1/a.sfv", "": None, ".": None, "..": None, "a/../b.nfo": None, "a//b.nfo": None, "/abs/x.nfo": None, "C:relative.nfo": None}),
    (names.normal_path, {" ./a\\b/ ": "a/b", "a/../b": None, "": None, "///": None}),
    (names.relative, {"a/./b": "a/b", "a/../b": "b", "../x": None, "/x": None, "a/../../x": None}),
    (names.part_number, {"a.part07.rar": 7, "a.r00": None}),
    (names.old_order, {"a.rar": -1, "a.r00": 0, "a.s05": 105, "a.q99": -1, "a.001": 1, "a.txt": 2**31 - 1}),
    (names.is_volume, {"a.rar": True, "a.r00": True, "a.001": True, "a.txt": False, "a": False}),
    (scalars.version, {"winrar-560": 560, "winrar-56": 560, "rarlinux-x64-5.5.0": 550, "rarlinux-3.0": 300, "rarosx-6.0.2": 602, "winrar-beta": None, "rar5": 50}),
    (scalars.version_tag, {"winrar-250b2": "b2", "winrar-x64-250-beta1": "beta1", "wrar-380-de": "de", "winrar-beta": None}),
])
def test_names(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_null_names(spark):
    for fn in (names.next_old_volume, names.next_new_volume, names.base_name, names.canonical, names.normal_path, scalars.version):
        assert values(spark, fn, [None]) == [None]


@pytest.mark.parametrize(("fn", "cases"), [
    (scalars.archive_format, {499: "RAR4", 500: "RAR5", 699: "RAR5", 700: "RAR7"}),
    (scalars.dictionary_size, {0x00: 64, 0x20: 128, 0xC0: 4096, 0xE0: 0}),
    (scalars.method_name, {0: "Store", 0x33: "Normal", 9: "Unknown (0x09)", None: "Unknown"}),
    (scalars.host_name, {3: "Unix", 9: "Unknown (9)"}),
    (scalars.human_size, {1024: "1024 B", 1536: "1.5 KiB", 1048577: "1.00000095367431640625 MiB", 0: "0 B"}),
    (scalars.vint, {0: "80", 126: "FE", 127: "407F", 16382: "7FFE", 16383: "203FFF"}),
    (scalars.dos_time, {0: None, (44 << 25) | (2 << 21) | (29 << 16) | (12 << 11): dt.datetime(2024, 2, 29, 12), (44 << 25) | (13 << 21) | (1 << 16): None, (44 << 25) | (1 << 21): None}),
])
def test_numbers(spark, fn, cases):
    got = values(spark, fn, list(cases), "long")
    if fn is scalars.human_size:
        got[2], cases = got[2].split()[1], cases | {1048577: "MiB"}
    assert got == list(cases.values())


def test_signed_vint(spark):
    assert values(spark, scalars.signed_vint, ["BF", "C0", "BE", "80", "6000"]) == [0, 1, -1, -63, 1]


def test_known_bad(spark):
    rows = spark.createDataFrame([(620, "RAR4", ["-tsc-"]), (620, "RAR5", ["-tsc-", "-ma5"]), (560, "RAR4", ["-tsc-"]), (700, "RAR7", ["-tsc-"]), (620, "RAR4", ["-m5"])], "v int, f string, a array<string>")
    assert [r[0] for r in rows.select(scalars.known_bad(F.col("v"), F.col("f"), F.col("a"))).collect()] == [True, False, False, False, False]


def test_arguments(spark):
    rows = spark.createDataFrame([(["-m3"], 600)], "a array<string>, v int")
    final = scalars.final_arguments(F.col("a"), F.col("v"), F.lit(True), F.lit("c d"), F.lit(True))
    assert rows.select(scalars.joined_arguments(final)).first()[0] == '-cfg- -ma4 -m3 -vn "-zc d" -ds'


def test_digests(spark):
    rows = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(),)], "b binary")
    got = rows.select(scalars.digest(F.col("b"), F.lit("crc32")), scalars.digest(F.col("b"), F.lit("sha1"))).collect()
    assert [r[0] for r in got] == ["cbf43926", "00000000"]
    assert got[1][1] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_header_crc(spark):
    header = b"\x00\x00" + b"abcdefg"
    rows = spark.createDataFrame([(bytearray(header), zlib.crc32(header[2:]) & 0xFFFF), (bytearray(header), 1)], "h binary, c int")
    assert [r[0] for r in rows.select(scalars.header_crc_valid(F.col("h"), F.col("c"))).collect()] == [True, False]


def test_searches(spark):
    data = b"\xc3\xa9\xffAxAAxA"
    rows = spark.createDataFrame([(bytearray(data),)], "d binary")
    d, a = F.col("d"), F.lit(bytearray(b"A"))
    got = rows.select(
        scalars.find_forward(d, a), scalars.find_forward(d, a, F.lit(4)), scalars.find_backward(d, a, F.lit(7)), scalars.find_forward(d, F.lit(bytearray(b"zz"))),
        scalars.count_all(d, F.lit(bytearray(b"AA"))), scalars.find_all(d, a), scalars.matches_at(d, a, F.lit(3)),
    ).first()
    assert tuple(got) == (3, 5, 6, -1, 1, [3, 5, 6, 8], True)


def test_locate_tiers(spark):
    rows = spark.createDataFrame([(bytearray(bytes(100) + b"sig" + bytes(100)), h) for h in (100, 105, 190, 0)] + [(bytearray(b"none"), 0)], "d binary, h long")
    got = rows.select(scalars.locate(F.col("d"), F.lit(bytearray(b"sig")), F.col("h"), radius=10).alias("l")).select("l.*").collect()
    assert [tuple(r) for r in got] == [(100, 1), (100, 2), (100, 3), (100, 3), (-1, 0)]


def test_patterns(spark):
    assert [None if v is None else bytes(v) for v in values(spark, lambda c: scalars.pattern(c, True), ["52 61-72", "5", "zz", " ", ""])] == [b"Rar", None, None, None, None]


def test_manifest_lines(spark):
    lines = ["; comment", "aln-re4a.r00 88B361C9", "broken", "sub title.rar 12345678", ""]
    assert [None if v is None else tuple(v) for v in values(spark, manifests.entry, lines)] == [None, ("aln-re4a.r00", "88b361c9"), None, None, None]
    assert values(spark, manifests.entry_name, lines) == [None, "aln-re4a.r00", None, "sub title.rar", None]
