"""Logical positions on volumes: interval lookups, clipped runs, reassembly of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Assembled files leave a task in batches of about so many bytes, or rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024


def lookup(positions: DataFrame, extents: DataFrame, group: list[str], size: int) -> DataFrame:
    """positions (group, pos) with the extent (group, start, stop, ...) that holds them: start <= pos < stop.

    Both sides are cut into bins of the given size, so that the range join is
    an equality of group and bin; an extent stands in each bin that it meets.
    """
    cut = extents.where("start < stop").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    keyed = positions.withColumn("_bin", F.floor(F.col("pos") / size))
    return keyed.join(cut, [*group, "_bin"]).where("pos >= start and pos < stop").drop("_bin")


def clipped(chunks: DataFrame, limits: DataFrame, group: list[str], order: list[str], size: str = "size") -> DataFrame:
    """Chunks up to a group's limit: take is how much of each is read; chunks beyond it go."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    joined = chunks.withColumn("before", before).join(limits, group)
    return joined.withColumn("take", F.least(F.col(size), F.col("limit") - F.col("before"))).where("take > 0")


def assemble(pieces: DataFrame, group: str, order: str = "ord", data: str = "data") -> DataFrame:
    """(group, data): the pieces of each group in order, as one binary.

    Pieces are dealt by group and sorted on disk where need be; a task holds
    one file's bytes at a time, and no more than it has collected for output.
    """
    kind = pieces.schema[group].dataType.simpleString()
    rows = pieces.select(group, order, data).repartition(group).sortWithinPartitions(group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, keys, done, size = None, None, [], [], 0
        type_ = None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(keys, type_), pa.array(done, pa.binary())], names=[group, "data"])
        for batch in batches:
            type_ = batch.schema.field(0).type
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if parts is None or k != key:
                    if parts is not None:
                        keys.append(key)
                        done.append(b"".join(parts))
                        size += len(done[-1])
                    key, parts = k, []
                    if size >= BATCH_BYTES or len(keys) >= BATCH_ROWS:
                        yield made()
                        keys, done, size = [], [], 0
                if piece.is_valid:
                    parts.append(piece.as_py())
        if parts is not None:
            keys.append(key)
            done.append(b"".join(parts))
            yield made()

    return rows.mapInArrow(run, f"{group} {kind}, data binary")
