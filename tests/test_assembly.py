"""Preflight, sections, comments, element values, entry hashes, and placing files."""

import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import chains, diff, match, resolve
from quarry.plans import catalog
from quarry.sources import readers, sinks
from quarry.sources.codecs import archive, media


def service(name: bytes, data: bytes, size: int | None = None) -> bytes:
    """A service block written by hand."""
    body = struct.pack("<IIBIIBBHI", len(data) if size is None else size, len(data), 2, 0, 0, 29, 0x30, len(name), 0) + name
    head = struct.pack("<BHH", archive.SERVICE, archive.LONG_BLOCK, 7 + len(body)) + body
    return struct.pack("<H", __import__("zlib").crc32(head) & 0xFFFF) + head + data


def skeletons(spark, **files):
    return readers.skeletons(spark.createDataFrame([(n, bytearray(d)) for n, d in files.items()], "path string, content binary"), broken=True)


def test_preflight_and_sections(spark):
    head, volume = archive.skeleton_header("x"), archive.volume_block("a.rar")
    main = archive.simple4(archive.ARCHIVE, 0, bytes(6))
    protected = archive.simple4(archive.ARCHIVE, 0x40, bytes(6))
    second = archive.volume_block("b.rar") + archive.MARK4 + protected
    rows = skeletons(
        spark, ok=head + volume + archive.MARK4 + main + service(b"CMT", b"hi"), protected=head + volume + archive.MARK4 + protected, rr=head + volume + archive.MARK4 + main + service(b"RR", b"", 0),
        stripped=head + volume + archive.MARK4 + main + service(b"AV", b"", 5), headless=volume + archive.MARK4 + protected, cut=head + volume[:-1], two=head + volume + archive.MARK4 + main + second, empty=head,
    )
    told = lambda df: {r["path"]: (r["status"], r["reason"]) for r in df.collect()}
    got = told(readers.preflight(rows))
    assert got["ok"] == ("Ok", None) and got["empty"] == ("Ok", None) and got["two"] == got["protected"] == ("Declined", "recovery record")
    assert got["rr"] == ("Declined", "recovery record") and got["stripped"] == ("Declined", "stripped service data: AV")
    assert got["headless"] == ("Error", "no header block") and got["cut"][0] == "Error"
    wanted = spark.createDataFrame([("two", "a.rar"), ("protected", "z.rar")], "path string, name string")
    chosen = told(readers.preflight(rows, wanted))
    assert chosen["two"] == ("Ok", None) and chosen["protected"] == ("Ok", None) and chosen["cut"][0] == "Error"
    listed = {(r["path"], r["position"], r["name"]) for r in readers.sections(rows).collect()}
    assert {x for x in listed if x[0] == "two"} == {("two", 0, "a.rar"), ("two", 1, "b.rar")} and not any(x[0] == "cut" for x in listed)


def test_comment_text(spark):
    raws = ["plain".encode(), "é\0\0".encode(), bytes(range(128, 256)), b"a\x82\0", b"", None, "�".encode()]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(raws)], "i int, data binary")
    got = [r[0] for r in df.orderBy("i").select(scalars.comment_text(F.col("data"))).collect()]
    assert got == ["plain", "é", bytes(range(128, 256)).decode("cp437"), "aé", "", None, "�".encode().decode("cp437")]


def test_element_values(spark):
    cases = [("uint", "", "0"), ("uint", "0100", "256"), ("int", "ff", "-1"), ("float", "3fc00000", "1.5"), ("float", "40000000", "2"), ("float", "3dcccccd", "0.1"), ("float", "", ""), ("text", "61620000", "ab"), ("binary", "", "0 bytes"), ("binary", "0aff", "2 bytes: 0A FF")]
    cases += [("float", "00", "1 bytes: 00"), ("uint", "00" * 9, "9 bytes: " + "00 " * 8 + "00"), ("binary", "00" * 17, "17 bytes: " + "00 " * 16 + "…"), ("date", "", ""), ("date", "00", "2001-01-01 00:00:00 UTC"), ("date", f"{-1 & (1 << 64) - 1:016x}", "2000-12-31 23:59:59 UTC")]
    assert [media.ebml_text(k, bytes.fromhex(v)) for k, v, _ in cases] == [w for _, _, w in cases]
    assert media.ebml_text("binary", bytes(1 << 20) + b"x") == "1,048,577 bytes"
    data = bytes.fromhex("1654ae6b") + bytes([0x80 | 4]) + bytes.fromhex("428681") + b"\x01"
    rows = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    assert [(r["element_id"], r["value"]) for r in readers.element_values(rows, {0x4286: "uint"}).collect()] == [(0x4286, "1")]


def test_sum_hashes_of_entries(spark):
    import zlib

    data = bytes(range(256)) * 300
    crc = zlib.crc32(data)
    v1 = archive.volume4([archive.file4("f.bin", data[:50_000], archive.SPLIT_AFTER, unpacked=len(data), crc=1), ])
    v2 = archive.volume4([archive.file4("f.bin", data[50_000:], archive.SPLIT_BEFORE, unpacked=len(data), crc=crc), archive.file4("small", b"x", crc=zlib.crc32(b"x"))])
    content = spark.createDataFrame([("a.rar", bytearray(v1)), ("a.r00", bytearray(v2))], "path string, content binary")
    volumes = spark.createDataFrame([("a.rar", "s|1", 0), ("a.r00", "s|1", 1)], "path string, set_key string, position int")
    got = [(r["set_key"], r["name"], r["size"], bytes(r["hash"])) for r in chains.sum_hashes(readers.blocks(content), volumes, content).collect()]
    assert got == [("s|1", "f.bin", len(data), archive.oso_hash(data))]


def test_gates_of_odd_rows(spark):
    produced = spark.createDataFrame([(1, 0, "AA"), (3, 0, None)], "g int, position int, crc string")
    expected = spark.createDataFrame([(1, 0, "v", "aa"), (2, 0, "v", "bb"), (3, 0, "v", "cc")], "g int, position int, name string, crc string")
    got = {r["g"]: (r["passes"], r["reason"]) for r in match.full_set_gate(produced, expected, ["g"]).collect()}
    assert got[1] == (True, None) and got[2] == (False, "produced 0 volume(s), expected 1") and got[3][0] is False
    assert all(r["passes"] for r in match.full_set_gate(produced, expected, ["g"], complete=False).collect())
    assert all(r["passes"] for r in match.full_set_gate(produced, expected.limit(0), ["g"]).collect())
    tracks = spark.createDataFrame([(1, 1, 4), (1, 2, 0), (2, 1, 4)], "g int, track_no int, signature_size int")
    found = spark.createDataFrame([(1, 1, 7), (1, 2, 0), (2, 1, 0)], "g int, track_no int, offset long")
    assert {tuple(r) for r in match.unlocated(match.verified_tracks(tracks, found, ["g"]), ["g"]).collect()} == {(1, 2, 1, False), (2, 1, 0, True)}
    runs = spark.createDataFrame([(1, "a"), (2, None), (3, " A")], "n int, digest string")
    kept = {r["n"]: (r["matched"], r["keep"]) for r in match.first_volume_gate(runs, spark.createDataFrame([("a",)], "digest string"), "digest", "n", delete_all=True).collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (True, True)}


def test_odd_fields_and_maps(spark):
    ddl = "k int, data_size int, field_no int, name string, value string"
    left = spark.createDataFrame([(1, 0, 0, "A", None), (1, 0, 1, "CRC32", "x"), (2, 0, 0, "A", "1")], ddl)
    right = spark.createDataFrame([(1, 0, 0, "A", ""), (1, 0, 1, "CRC32", "y"), (1, 0, 2, "B", "1"), (3, 0, 0, "A", "1")], ddl)
    got = sorted(tuple(r) for r in diff.field_pairs(left, right, ["k"]).collect())
    assert got == [(1, 0, "A", "N/A", ""), (1, 2, "B", "N/A", "1")]
    assert [tuple(r) for r in diff.quick_check(left, right, ["k"]).collect()] == [(1, True)]
    assert [tuple(r) for r in diff.quick_check(left, left.where("k = 2"), ["k"]).collect()] == [(2, False)]
    pairs = spark.createDataFrame([(1, None, "a", None, "A"), (2, "a", "a", "A", "A")], "k int, left_kind string, right_kind string, left_type string, right_type string")
    none = lambda df: df.where("false").select("k", F.lit("").alias("property"), F.lit("").alias("left_value"), F.lit("").alias("right_value"))
    assert [tuple(r) for r in diff.compared(pairs, ["k"], {"a": none}).collect()] == [(1, "File Type", "Unknown", "A")]
    rows = spark.createDataFrame([(1, "b", 2, 1), (1, "a", 1, 0), (1, "b", 9, 2), (1, None, 5, 3)], "g int, k string, v int, o int")
    assert resolve.as_map(rows, ["g"], "k", "v", "o").collect()[0]["entries"] == {"a": 1, "b": 2}



def test_kinds_compared_by_columns(spark):
    """Columns and functions give the same rows; columns read the pairs once."""
    ddl = "k int, left_kind string, right_kind string, left_type string, right_type string, l int, r int"
    rows = [(1, "a", "a", "A", "A", 1, 2), (2, "a", "a", "A", "A", 1, 1), (3, "a", "a", "A", "A", None, 1), (4, "b", "b", "B", "B", 5, 6), (5, "a", "b", "A", "B", 1, 2), (6, "c", "c", "C", "C", 1, 1), (7, None, None, None, None, 1, 2)]
    pairs = spark.createDataFrame(rows, ddl)
    text = [F.col(c).cast("string").alias(f"{side}_value") for c, side in (("l", "left"), ("r", "right"))]
    row = lambda p: F.when(F.col("l") != F.col("r"), F.array(F.struct(F.lit(p).alias("property"), *text)))
    fn = lambda p: lambda df: df.where("l <> r").select("k", F.lit(p).alias("property"), *text)
    found = lambda by: sorted(map(tuple, diff.compared(pairs, ["k"], by).collect()))
    want = [(1, "X", "1", "2"), (4, "Y", "5", "6"), (5, "File Type", "A", "B"), (6, "File Type", "C", "C"), (7, "File Type", "Unknown", "Unknown")]
    assert found({"a": row("X"), "b": row("Y")}) == want
    assert found({"a": row("X"), "b": fn("Y")}) == want
    assert found({"a": fn("X"), "b": fn("Y")}) == want


def test_compare_by_kind_joins_once(spark, tmp_path):
    """Over orders of all statuses, with null customers; each pair is joined once."""
    rows = [(k, None if k % 5 == 0 else k * k % 7, "FOP"[k // 3 % 3]) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    out = catalog.QUERIES["compare_by_kind"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(catalog.ORACLES["compare_by_kind"]).fetchall())


def test_place_and_guard(tmp_path):
    a, b, c = (tmp_path / n for n in "abc")
    a.write_text("1"), b.write_text("2")
    sub = tmp_path / "d"
    assert sinks.place([(str(a), str(b))]) == [] and a.read_text() == "1"
    assert sinks.place([(str(a), str(sub / "x")), (str(b), str(sub / "x"))]) == []
    assert sinks.place([(str(a), str(sub / "a")), (str(tmp_path / "none"), str(sub / "n"))]) == [] and a.read_text() == "1"
    assert sinks.place([(str(a), str(a)), (str(b), str(sub / "b"))]) == [str(a), str(sub / "b")] and not b.exists()
    c.symlink_to(a)
    with pytest.raises(ValueError, match="output is a volume"):
        sinks.reject_inputs(str(a), [str(c)], "a volume")
    sinks.reject_inputs(str(a), [str(sub / "b")])


def test_assemble_over_batches(spark):
    """Null keys and pieces, groups over several batches, groups without bytes, no rows."""
    from quarry.operators import extents

    rows = [(g, o, bytearray(f"{g}.{o}|".encode())) for g in ("a", "b") for o in range(50)] + [(None, 1, bytearray(b"y")), (None, 0, bytearray(b"x")), ("c", 0, None)]
    df = spark.createDataFrame(rows, "g string, ord int, data binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["g"]: bytes(r["data"]) for r in extents.assemble(df, "g").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: "".join(f"{g}.{o}|" for o in range(50)).encode() for g in ("a", "b")} | {None: b"xy", "c": b""}
    assert extents.assemble(df.where("false"), "g").collect() == []
