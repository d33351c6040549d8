"""Files as they arrive: the same parsers over a stream, and a signature search that goes on from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """(path, content) of new files under a path; no more than per_trigger in a batch."""
    rows = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.select("path", "content")


def into(rows: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that parses what arrives into Parquet; each file's rows are written exactly once."""
    return parse(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def find_in_chunks(chunks: DataFrame, signature: bytes) -> DataFrame:
    """(track, found): offset of a signature in each track's chunks (track, offset, data), as they arrive in order.

    What is kept of a track is the tail that a match may start in, one byte
    shorter than the signature; a track's first match is told once.
    """
    keep = len(signature) - 1

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, start, done = state.get if state.exists else (b"", 0, False)
        found = []
        for rows in frames:
            for offset, data in sorted(zip(rows["offset"], rows["data"], strict=True), key=lambda x: x[0]):
                if done:
                    continue
                if not tail:
                    start = int(offset)
                joined = bytes(tail) + bytes(data)
                at = joined.find(signature)
                if at >= 0:
                    found.append(start + at)
                    done = True
                else:
                    cut = max(0, len(joined) - keep)
                    tail, start = joined[cut:], start + cut
        state.update((tail, start, done))
        if found:
            yield pd.DataFrame({"track": [key[0]], "found": found})

    return chunks.select(F.col("track").cast("long"), "offset", "data").groupBy("track").applyInPandasWithState(step, "track long, found long", "tail binary, start long, done boolean", "append", GroupStateTimeout.NoTimeout)
