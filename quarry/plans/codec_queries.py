"""Round trips through the binary codecs over whole driver tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.tables import Registry, table
from quarry.sources import readers
from quarry.sources.codecs import archive, media

R = Registry()


def _content(df: DataFrame, key: str, text: str) -> DataFrame:
    """(path, content): the key as text and the text's bytes."""
    return df.select(F.col(key).cast("string").alias("path"), F.col(text).cast("binary").alias("content"))


def _volume(data: bytes, key: str) -> bytes:
    """Each text as one stored file, in a volume of format 4 or 5 by its length."""
    return archive.volume5([archive.file5(f"{key}.txt", data)]) if len(data) % 2 else archive.volume4([archive.file4(f"{key}.txt", data)])


@R.add("SELECT CAST(doc_id AS VARCHAR) AS path, doc_id || '.txt' AS name, strlen(text) AS size, CASE WHEN strlen(text) % 2 = 1 THEN 5 ELSE 4 END AS format, true AS crc_valid FROM documents")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text packed into a volume, and the volume's file blocks read back."""
    rows = _content(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = readers.blocks(rows, _volume).where((F.col("type") == archive.FILE) | ((F.col("format") == 5) & (F.col("type") == 2)))
    return found.select("path", "name", F.col("add_size").alias("size"), "format", "crc_valid")


@R.add("SELECT CAST(doc_id AS VARCHAR) AS path, sha1(text) AS sha1 FROM documents")
def volume_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through volume, skeleton and rebuilt volume; the file's bytes are hashed."""

    def parse(path: str, data: bytes) -> Iterator[dict]:
        import hashlib

        file = lambda v: next(b for b in archive.volume_blocks(v) if b["name"])
        cut = lambda v, b: v[b["data_offset"] : b["data_offset"] + b["add_size"]]
        skeleton = archive.make_skeleton([("a.rar", data)])
        made = archive.rebuild_volumes(skeleton, {file(data)["name"]: cut(data, file(data))})["a.rar"]
        if made == data:
            yield {"sha1": hashlib.sha1(cut(made, file(made))).hexdigest()}

    rows = _content(table(spark, sf_dir, "documents"), "doc_id", "text")
    return readers.parsed(rows, parse, "sha1 string", _volume)


@R.add("SELECT CAST(page_id AS VARCHAR) AS path, CASE page_id % 3 WHEN 0 THEN 'AVI' WHEN 1 THEN 'MKV' ELSE 'MP4' END AS kind, strlen(html) AS n_payload, true AS crc_ok FROM pages WHERE strlen(html) > 0")
def media_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the payload of a media sample, through its skeleton and back."""
    import struct

    from quarry.sources.codecs.bits import id_bytes, to_vint

    def sample(data: bytes, key: str) -> bytes:
        if int(key) % 3 == 0:
            movi = b"movi00dc" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
            body = b"AVI LIST" + struct.pack("<I", 16) + b"hdrlavih" + struct.pack("<I", 4) + bytes(4) + b"LIST" + struct.pack("<I", len(movi)) + movi
            return b"RIFF" + struct.pack("<I", len(body)) + body
        if int(key) % 3 == 1:
            block = id_bytes(0xA3) + to_vint(len(data) + 4) + b"\x81\0\0\x80" + data
            cluster = id_bytes(0x1F43B675) + to_vint(len(block)) + block
            return id_bytes(0x1A45DFA3) + to_vint(0) + id_bytes(0x18538067) + to_vint(len(cluster)) + cluster
        return struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", len(data) + 8) + b"mdat" + data

    def parse(path: str, data: bytes) -> Iterator[dict]:
        kind = media.sniff(data)
        made = media.rebuild(media.make_skeleton(data, kind, "s"), data)
        yield {"kind": kind, "n_payload": sum(t["data_length"] for t in media.profile(data, kind)["tracks"]), "crc_ok": made["crc_ok"] and made["data"] == data}

    rows = _content(table(spark, sf_dir, "pages"), "page_id", "html")
    return readers.parsed(rows, parse, "kind string, n_payload long, crc_ok boolean", sample).where("n_payload > 0")


@R.add("""WITH d AS (SELECT item_id, hex(encode(repeat(text, 1 + CAST(65536 // strlen(text) AS BIGINT)))) AS h FROM benchmark WHERE text <> ''),
    b AS (SELECT item_id, len(h) // 2 AS size, regexp_extract_all(h[1:131072] || h[-131072:], '..') AS l FROM d),
    w AS (SELECT item_id, size, unnest(l) AS x, unnest(range(0, 131072)) AS pos FROM b),
    s AS (SELECT item_id, size, (size + sum(CAST(CAST('0x' || x AS BIGINT) AS HUGEINT) * CAST(pow(2, 8 * (pos % 8)) AS HUGEINT))) % 18446744073709551616 AS v FROM w GROUP BY item_id, size)
    SELECT CAST(item_id AS VARCHAR) AS path, size, list_reduce(regexp_extract_all(printf('%08x', CAST(v // 4294967296 AS BIGINT)) || printf('%08x', CAST(v % 4294967296 AS BIGINT)), '..'), lambda a, x: x || a) AS hash FROM s""")
def oso_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of sums, modulo 2^64, over the first and last 64 KiB of each passage, repeated until it is that long."""
    longer = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.expr("repeat(text, cast(1 + 65536 div octet_length(text) as int))").alias("text"))
    return readers.oso_hashes(_content(longer, "item_id", "text")).select("path", "size", F.lower(F.hex("hash")).alias("hash"))
