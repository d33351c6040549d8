"""Bytes back to files: encoders over DataFrames, and a sink that stages and renames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.sources.batches import pairs
from quarry.sources.codecs import archive, media


def skeletons_of(volumes: DataFrame, app: str = "quarry") -> DataFrame:
    """(name, data): one skeleton for each set_key of (set_key, ord, name, data) volumes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ord")
        made = archive.make_skeleton(list(zip(rows.column("name").to_pylist(), rows.column("data").to_pylist(), strict=True)), app=app)
        return pa.table({"name": rows.column("set_key")[:1].cast(pa.string()), "data": pa.array([made], pa.binary())})

    return volumes.select("set_key", "ord", "name", "data").groupBy("set_key").applyInArrow(run, "name string, data binary")


def media_skeletons_of(samples: DataFrame) -> DataFrame:
    """(name, data): the skeleton of each (path, content) sample; unknown containers give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pairs(batches):
            names, made = [], []
            for path, data in part:
                raw = data or b""
                if kind := media.sniff(raw, path):
                    names.append(path.rsplit("/", 1)[-1])
                    made.append(media.make_skeleton(raw, kind, path))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], names=["name", "data"])

    return samples.select("path", "content").mapInArrow(run, "name string, data binary")


def patched(volumes: DataFrame, host: int | None = None, attributes: int | None = None) -> DataFrame:
    """(path, content): format-4 volumes with their file headers patched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pairs(batches):
            made = [archive.patch4(data, host, attributes) for _, data in part]
            yield pa.RecordBatch.from_arrays([pa.array([path for path, _ in part], pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return volumes.select("path", "content").mapInArrow(run, "path string, content binary")


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Each task writes beside the target under a name of its own; commit renames all, abort removes all."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Staged:
        moves = []
        for r in rows:
            parts = r["name"].replace("\\", "/").split("/")
            if any(p in ("", ".", "..") for p in parts) or ":" in parts[0]:
                raise ValueError(f"refused name: {r['name']}")
            target = os.path.join(self.folder, *parts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            staged = f"{target}.{uuid.uuid4().hex}.part"
            with open(staged, "xb") as f:
                f.write(r["data"] or b"")
            moves.append((staged, target))
        return Staged(moves)

    def commit(self, messages: list) -> None:
        moves = [m for message in messages if message for m in message.moves]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for staged, target in moves:
            os.replace(staged, target)

    def abort(self, messages: list) -> None:
        for message in messages:
            for staged, _ in message.moves if message else []:
                if os.path.exists(staged):
                    os.remove(staged)


class FileSink(DataSource):
    """df of (name, data): df.write.format("quarry_files").mode("append").save(folder), a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def reject_inputs(output: str, inputs: Iterable[str], kind: str = "an input") -> None:
    """An error when an output path is one of the inputs, links followed, whatever the case."""
    key = os.path.realpath(output).lower()
    for path in inputs:
        if os.path.realpath(path).lower() == key:
            raise ValueError(f"output is {kind}: {path}")


def place(moves: list[tuple[str, str]]) -> list[str]:
    """Move one set's files (source, target); returns the targets, or nothing at all when any can't be moved.

    Targets that are taken by another file end it before the first move; a
    failure later undoes the moves made so far.  A source that is its own
    target stays.
    """
    same = lambda a, b: os.path.realpath(a) == os.path.realpath(b)
    if any(os.path.exists(t) and not same(s, t) for s, t in moves) or len({os.path.realpath(t) for _, t in moves}) < len(moves):
        return []
    made: list[tuple[str, str]] = []
    try:
        for source, target in moves:
            if not same(source, target):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.rename(source, target)
                made.append((source, target))
    except OSError:
        for source, target in reversed(made):
            os.rename(target, source)
        return []
    return [t for _, t in moves]
