"""Sources and sinks over real folders; operators that registered queries don't reach."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import edit, extents, match
from quarry.plans import catalog
from quarry.sources import batches, manifests, readers, sinks
from quarry.sources.codecs import archive
from tests.test_codecs import samples
from tests.test_queries import SF


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("release")
    payload = bytes(range(256)) * 300
    for name, part in (("r.rar", payload[:40_000]), ("r.r00", payload[40_000:])):
        (d / name).write_bytes(archive.volume4([archive.file4("m.mkv", part)]))
    (d / "r.sfv").write_bytes(b"; made\r\nr.rar 0a0b0c0d\r\nr.r00 11223344\r\n\xe9 bad\r\n")
    (d / "r.sha1").write_bytes(b"da39a3ee5e6b4b0d3255bfef95601890afd80709 *r.rar\nshort *x\n")
    (d / "big.dat").write_bytes(payload)
    (d / "empty.rar").write_bytes(b"")
    for kind, data in samples().items():
        (d / f"{kind.lower()}.{'vob' if kind == 'Stream' else 'bin'}").write_bytes(data)
    return str(d)


def test_blocks(spark, folder):
    rows = readers.read(spark, folder, "blocks", "*.r[a0]*").where(F.col("type") == archive.FILE).orderBy("path").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["name"], r["add_size"]) for r in rows] == [("r.r00", "m.mkv", 36_800), ("r.rar", "m.mkv", 40_000)]


def test_manifests(spark, folder):
    sfv = manifests.read_sfv(spark, folder).orderBy("line_no").collect()
    assert [(r["name"], r["digest"], r["line_no"]) for r in sfv] == [("r.rar", "0a0b0c0d", 1), ("r.r00", "11223344", 2)]
    with pytest.raises(Exception, match="not an SFV line"):
        manifests.read_sfv(spark, folder, tolerant=False).collect()
    sha = manifests.read_sha1(spark, folder)
    assert [r["name"] for r in sha.collect()] == ["r.rar"]
    assert [r["value"] for r in manifests.sha1_lines(sha).collect()] == ["da39a3ee5e6b4b0d3255bfef95601890afd80709 *r.rar"]


def test_containers_and_their_skeletons(spark, folder, tmp_path):
    rows = manifests.files(spark, folder, "*.{bin,vob}")
    assert {r["kind"] for r in readers.containers(rows).collect()} == set(samples())
    made = sinks.media_skeletons_of(rows).withColumnsRenamed({"name": "path", "data": "content"})
    told = readers.media_skeletons(made).groupBy("path").agg(F.first("size").alias("size"), F.first("kind").alias("kind")).collect()
    assert {r["kind"]: r["size"] for r in told} == {k: len(v) for k, v in samples().items()}


def test_oso(spark, folder):
    assert [r["size"] for r in readers.read(spark, folder, "oso_hashes", "*.dat").collect()] == [76_800]


def test_skeleton_sink_and_verifier(spark, folder, tmp_path):
    volumes = manifests.files(spark, folder, "r.r*").select(F.lit("set.srr").alias("set_key"), F.when(F.endswith("path", F.lit(".rar")), 0).otherwise(1).alias("ord"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("content").alias("data"))
    sinks.register(spark)
    sinks.skeletons_of(volumes).write.format("quarry_files").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["set.srr"]
    back = manifests.files(spark, str(tmp_path))
    rows = readers.skeletons(back, broken=True)
    assert rows.where("format = 4 and type = 116").count() == 2
    assert readers.verify(rows).count() == 0
    spoilt = back.withColumn("content", F.substring("content", 1, 60))
    assert {r["severity"] for r in readers.verify(readers.skeletons(spoilt, broken=True)).collect()} == {"Error"}


def test_sink_refuses_bad_names(spark, tmp_path):
    sinks.register(spark)
    bad = spark.createDataFrame([("../x", bytearray(b"1"))], "name string, data binary")
    with pytest.raises(Exception, match="refused name"):
        bad.write.format("quarry_files").mode("append").save(str(tmp_path))
    twice = spark.createDataFrame([("x", bytearray(b"1")), ("x", bytearray(b"2"))], "name string, data binary")
    with pytest.raises(Exception, match="same name"):
        twice.write.format("quarry_files").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_patched(spark, folder):
    rows = sinks.patched(manifests.files(spark, folder, "r.rar"), host=3)
    assert [r["host_os"] for r in readers.blocks(rows).where("name is not null").collect()] == [3]


def test_stored_files(spark):
    data = archive.make_skeleton([], [("a.nfo", b"one"), ("b.nfo", b"")])
    rows = spark.createDataFrame([("p", bytearray(data))], "path string, content binary")
    assert [(r["name"], bytes(r["data"])) for r in readers.stored_files(readers.skeletons(rows), rows).orderBy("ord").collect()] == [("a.nfo", b"one"), ("b.nfo", b"")]


def test_assemble(spark):
    rows = spark.createDataFrame([("a", 2, bytearray(b"c")), ("a", 0, bytearray(b"a")), ("a", 1, None), ("b", 0, bytearray(b"x"))], "g string, ord int, data binary")
    assert {r["g"]: bytes(r["data"]) for r in extents.assemble(rows, "g").collect()} == {"a": b"ac", "b": b"x"}


def test_sections(spark):
    sections = spark.createDataFrame([("CD1/a.rar",), ("CD2/A.rar",), ("b.rar",)], "name string")
    pick = lambda *q: {r["name"] for r in match.select_sections(sections, spark.createDataFrame([(x,) for x in q], "selector string")).collect()}
    assert pick("a.rar") == {"CD1/a.rar", "CD2/A.rar"}
    assert pick("cd1\\a.rar", "B.RAR") == {"CD1/a.rar", "b.rar"}


def test_adding_a_known_name_fails(spark):
    stored = spark.createDataFrame([("s", 0, "a.nfo")], "source string, ord long, name string")
    with pytest.raises(Exception, match="stored name exists"):
        edit.add(stored, spark.createDataFrame([("s", 0, "A.NFO")], stored.schema), ["source"]).collect()


def test_move_out_of_range_changes_nothing(spark):
    stored = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "source string, ord long, name string")
    out = edit.move(stored, spark.createDataFrame([("s", "a", 5)], "source string, name string, by long"), ["source"])
    assert sorted((r["ord"], r["name"]) for r in out.collect()) == [(0, "a"), (1, "b")]


class Caught:
    """Stands for a DataFrame; mapInArrow gives the mapped function."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_mapped_functions_hold_few_files():
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(2000))), pa.array([b"x"] * 2000, pa.binary())], names=["path", "content"])
    assert next(sinks.patched(Caught())(iter([batch]))).num_rows <= batches.ROWS
    made = []
    run = readers.parsed(Caught(), lambda path, data: [{"n": len(data)}] * 2, "n long", lambda data, path: made.append(path) or data * 3)
    out = run(iter([batch]))
    assert next(out).num_rows <= batches.ROWS and len(made) <= batches.ROWS
    assert sum((b.num_rows for b in out), batches.ROWS) == 4000 and made == [str(i) for i in range(2000)]


def test_pairs_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(batches, "BYTES", 10)
    content = [b"12345", b"12345", b"1", None, b"123456789012", b"", b"x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(content, pa.binary())], names=["path", "content"])
    got = list(batches.pairs(iter([batch.slice(0, 0), batch])))
    assert [[k for k, _ in p] for p in got] == [[0, 1], [2, 3], [4], [5, 6]]
    assert [v for p in got for _, v in p] == content


@pytest.mark.parametrize("name", ["archive_scan", "volume_rebuild", "media_rebuild", "oso_hash"])
def test_one_python_pass(spark, name):
    """Files made from rows and parsed at once take one worker in a task."""
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
