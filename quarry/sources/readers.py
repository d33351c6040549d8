"""Binary files as DataFrames: one Arrow pass over (path, content), one row for each block, track or node."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.sources.batches import ROWS, pairs
from quarry.sources.codecs import archive, disc, fields, media
from quarry.sources.manifests import files


def parsed(rows: DataFrame, parse: Callable[[str, bytes], Iterable[dict]], schema: str, make: Callable[[bytes, str], bytes] | None = None) -> DataFrame:
    """The rows that parse gives for each (path, content), with path in front; few files are held at once.

    make(content, path) gives the bytes that are parsed in place of the content:
    files made from rows need no Python pass, and no worker, of their own.
    """
    fields = to_arrow_schema(StructType.fromDDL(f"path string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pairs(batches):
            found = ({"path": path} | r for path, content in part for r in parse(path, make(content or b"", path) if make else content or b""))
            for some in itertools.batched(found, ROWS):
                yield pa.RecordBatch.from_pylist(list(some), schema=fields)

    return rows.select("path", "content").mapInArrow(run, f"path string, {schema}")


def blocks(rows: DataFrame, make: Callable[[bytes, str], bytes] | None = None) -> DataFrame:
    """Blocks of archive volumes of either format; make as of parsed."""
    return parsed(rows, lambda _, data: archive.volume_blocks(data), archive.BLOCK, make)


def skeletons(rows: DataFrame, broken: bool = False) -> DataFrame:
    """Blocks of skeletons and of the volume headers in them; broken: also the row that tells where one breaks off."""
    out = parsed(rows, lambda _, data: archive.skeleton_blocks(data), archive.BLOCK)
    return out if broken else out.where("error is null")


def containers(rows: DataFrame) -> DataFrame:
    """(path, kind, size, crc, track_no, data_length, signature): tracks of media samples; null tracks for unknown kinds."""

    def parse(path: str, data: bytes) -> Iterator[dict]:
        kind = media.sniff(data, path)
        if kind is None:
            yield {"kind": None, "size": len(data)}
            return
        facts = media.profile(data, kind)
        for t in facts["tracks"] or [{}]:
            yield {"kind": kind, "size": facts["size"], "crc": facts["crc"], "track_no": t.get("track_no"), "data_length": t.get("data_length"), "signature": t.get("signature")}

    return parsed(rows, parse, "kind string, size long, crc long, track_no long, data_length long, signature binary")


def media_skeletons(rows: DataFrame) -> DataFrame:
    """(path, kind, app, name, size, crc, track_no, data_length, match_offset, signature) of media skeletons."""

    def parse(path: str, data: bytes) -> Iterator[dict]:
        facts = media.parse_skeleton(data, path)
        file = facts["file"] or {}
        for t in facts["tracks"] or [{}]:
            yield {"kind": facts["kind"]} | {k: file.get(k) for k in ("app", "name", "size", "crc")} | {k: t.get(k) for k in ("track_no", "data_length", "match_offset", "signature")}

    return parsed(rows, parse, "kind string, app string, name string, size long, crc long, track_no long, data_length long, match_offset long, signature binary")


def elements(rows: DataFrame, cap: int = 1000) -> DataFrame:
    """EBML elements as an adjacency list; the row after the cap has no element_id."""
    return parsed(rows, lambda _, data: media.ebml_nodes(data, cap), "node_id long, parent_id long, element_id long, pos long, header_size int, data_size long, ordinal int")


def oso_hashes(rows: DataFrame) -> DataFrame:
    """(path, size, hash) of files of 64 KiB and more."""

    def parse(_: str, data: bytes) -> Iterator[dict]:
        digest = archive.oso_hash(data)
        if digest is not None:
            yield {"size": len(data), "hash": digest}

    return parsed(rows, parse, "size long, hash binary")


def header_fields(rows: DataFrame) -> DataFrame:
    """Every header field of archive volumes, with its place, bytes, value and description."""
    return parsed(rows, lambda _, data: fields.fields(data), fields.FIELD)


def first_names(rows: DataFrame) -> DataFrame:
    """(path, name) of the first file in each volume; what is no volume, or has no file, gives no row."""
    return parsed(rows, lambda _, data: ({"name": n} for n in (archive.first_name(data),) if n), "name string")


def disc_files(rows: DataFrame) -> DataFrame:
    """(path, name, offset, size) of the media files in disc images."""
    return parsed(rows, lambda _, data: disc.media_files(data), "name string, offset long, size long")


def read(spark: SparkSession, path: str, kind: str, glob: str = "*") -> DataFrame:
    """Files under a path by kind: blocks, skeletons, containers, media_skeletons, elements, header_fields, disc_files or oso_hashes."""
    return {"blocks": blocks, "skeletons": skeletons, "containers": containers, "media_skeletons": media_skeletons, "elements": elements, "header_fields": header_fields, "disc_files": disc_files, "oso_hashes": oso_hashes}[kind](files(spark, path, glob))


def stored_files(skeleton_rows: DataFrame, content: DataFrame) -> DataFrame:
    """(path, ord, name, data) of the files stored in skeletons."""
    s = skeleton_rows.where(F.col("type") == archive.S_STORED).select("path", F.col("block_no").alias("ord"), "name", "data_offset", "add_size")
    data = F.substring("content", (F.col("data_offset") + 1).cast("int"), F.col("add_size").cast("int"))
    return s.join(content, "path").select("path", "ord", "name", data.alias("data"))


def verify(skeleton_rows: DataFrame) -> DataFrame:
    """(path, pos, severity, rule) of skeletons read with broken=True."""
    from quarry.operators.resolve import issues

    own = F.col("format") == 0
    rules = [
        ("Error", "broken off", F.col("error").isNotNull() & (F.col("error") != "unknown block")),
        ("Warning", "unknown block", F.coalesce(F.col("error") == "unknown block", F.lit(False))),
        ("Warning", "sentinel", F.coalesce(own & F.col("error").isNull() & ~F.col("crc_valid"), F.lit(False))),
        ("Error", "first block is no header", (F.col("block_no") == 0) & F.coalesce(F.col("type") != archive.S_HEADER, F.lit(True))),
        ("Error", "header checksum", F.coalesce((F.col("format") > 0) & ~F.col("crc_valid"), F.lit(False))),
        ("Warning", "stored name", F.coalesce((F.col("type") == archive.S_STORED) & F.col("name").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.?([/\\]|$)"), F.lit(False))),
    ]
    return issues(skeleton_rows, rules, ["path", "pos"])


def sections(skeleton_rows: DataFrame) -> DataFrame:
    """(path, position, name) of the volumes that skeletons hold, in their order; none of a skeleton that breaks off."""
    from quarry.operators.diff import positioned

    broken = skeleton_rows.where(F.col("error").isNotNull()).select("path").distinct()
    rows = skeleton_rows.where((F.col("format") == 0) & (F.col("type") == archive.S_VOLUME)).join(broken, "path", "left_anti")
    return positioned(rows, ["path"], ["block_no"]).select("path", "position", "name")


def preflight(skeleton_rows: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(path, status, reason): whether skeletons, read with broken=True, can be assembled.

    Error: it breaks off, or has no header block before its volumes.  Else the
    first block that stops it: an end block that claims data (Error), or one
    of a selected volume (path, name; null: all of them) whose data a skeleton
    doesn't keep (Declined).  Else Ok.
    """
    rows = skeleton_rows
    if selected is not None:
        wanted = selected.select("path", F.col("name").alias("volume"), F.lit(True).alias("_wanted")).distinct()
        rows = rows.join(wanted, ["path", "volume"], "left")
    own = F.col("volume").isNotNull() if selected is None else F.col("_wanted").isNotNull()
    kind, flags = F.col("type"), F.col("flags")
    old, new = F.col("format") == 4, F.col("format") == 5
    stripped = F.col("add_size") > 0
    service = (old & (kind == archive.SERVICE)) | (new & (kind == 3))
    other = ~service & ~((old & kind.isin(archive.ARCHIVE, archive.FILE, archive.END, 0x72)) | (new & kind.isin(1, 2, 5)))
    end = old & (kind == archive.END) & (flags.bitwiseAND(archive.LONG_BLOCK) != 0)
    decline = F.when(
        own,
        F.when(old & (kind == archive.ARCHIVE) & (flags.bitwiseAND(0x40) != 0), "recovery record")
        .when(old & (kind == archive.PROTECT), "old recovery block")
        .when(service & (F.col("name") == "RR"), "recovery record")
        .when(service & (F.coalesce("name", F.lit("")) != "CMT") & stripped, F.concat(F.lit("stripped service data: "), F.coalesce("name", F.lit(""))))
        .when(other & stripped, F.concat(F.lit("stripped block data: "), F.col("type_name"))),
    )
    header = F.when((F.col("format") == 0) & (kind == archive.S_HEADER), F.col("block_no"))
    content = F.when((F.col("format") > 0) | (kind == archive.S_VOLUME), F.col("block_no"))
    stop = F.when(end, F.struct(F.lit("Error").alias("status"), F.lit("end block claims data").alias("reason"))).when(decline.isNotNull(), F.struct(F.lit("Declined").alias("status"), decline.alias("reason")))
    first = lambda why: F.min_by(why, F.when(why.isNotNull(), F.col("block_no")))
    facts = rows.groupBy("path").agg(first(F.col("error")).alias("_error"), first(stop).alias("_stop"), F.min(header).alias("_header"), F.min(content).alias("_content"))
    missing = F.when(F.col("_header").isNull() | (F.col("_content") < F.col("_header")), "no header block")
    wrong = F.coalesce("_error", missing)
    status = F.when(wrong.isNotNull(), "Error").otherwise(F.coalesce(F.col("_stop.status"), F.lit("Ok")))
    return facts.select("path", status.alias("status"), F.coalesce(wrong, F.col("_stop.reason")).alias("reason"))


def element_values(rows: DataFrame, kinds: dict[int, str], cap: int = 1000) -> DataFrame:
    """(path, node_id, element_id, value): shown values of the EBML elements of which kinds has the kind."""

    def parse(_: str, data: bytes) -> Iterator[dict]:
        for e in media.ebml_nodes(data, cap):
            if e["element_id"] in kinds:
                at = e["pos"] + e["header_size"]
                yield {"node_id": e["node_id"], "element_id": e["element_id"], "value": media.ebml_text(kinds[e["element_id"]], data[at : at + e["data_size"]])}

    return parsed(rows, parse, "node_id long, element_id long, value string")
