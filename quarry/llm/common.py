"""Helpers shared by the operators: tables, Arrow mapping, checkpoints, folds."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters that a mapped function holds as Python objects at once.
CHUNK_ROWS = 256
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batch: pa.RecordBatch, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and, unless one text is longer, few bytes."""
    start = 0
    sizes = None if text is None else pa.compute.binary_length(batch.column(text)).to_pylist()
    while start < batch.num_rows:
        end, held = start, 0
        while end < batch.num_rows and end - start < CHUNK_ROWS:
            held += 0 if sizes is None else sizes[end] or 0
            if held > CHUNK_BYTES and end > start:
                break
            end += 1
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, fn: Callable, schema: str, make: Callable | None = None) -> DataFrame:
    """Apply fn(ids, texts) -> list of columns to (id, text) rows, in small chunks.

    df has two columns, the id and the text; null texts arrive as None.  With
    ``make``, fn is called as fn(state, ids, texts), where state = make() is
    built once for each Python task.  The result has the columns of schema.
    """
    key, text = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (make(),) if make else ()
        for batch in batches:
            for part in chunks(batch, 1):
                columns = fn(*state, part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


_serial = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir.

    Where it is unset on one machine (tests), a local folder is set; on a
    cluster that is an error, since executors don't see each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            given = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        context.setCheckpointDir(given)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to a table in the shared folder and read again.

    Cuts the lineage: executors lost later cost no recomputation.  The table
    is compressed Parquet, so that it costs less disk than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}-{next(_serial)}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later result reads."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if "/quarry-" in path:
                jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fitted(rows: DataFrame, train: Callable):
    """train(rows as a list of dicts), run in one task over a bounded sample; what it returns comes back pickled.

    The driver holds neither the rows nor what training needs besides them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(held))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return train([]) if made is None else pickle.loads(made[0])  # no task ran without rows


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")), "UTF-8")) % n


def map_runs(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Apply fn to every group of rows with equal keys: {column: array} -> columns of schema, or None.

    For very many small groups, which would each cost a grouped map some
    milliseconds.  A group must fit into a task's memory; null keys aren't
    expected.  Integers arrive as numpy arrays, other columns as Arrow arrays.
    Groups are dealt to as many tasks as a shuffle has partitions: few bytes
    may take long, so that small partitions aren't joined.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def given(column: pa.Array):
        return column.to_numpy() if pa.types.is_integer(column.type) else column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for start in range(0, batch.num_rows, 2048):
                    held.append(batch.slice(start, min(2048, batch.num_rows - start)))
                    yield from settle(held, last=False)
            else:
                yield from settle(held, last=True)

    def settle(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Run the groups that have ended; the rows of the last one stay in held."""
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        if rows is None or not rows.num_rows:
            return
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            c = rows.column(k).combine_chunks()
            new[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), rows.num_rows)
        ends = len(starts) - 1 - (not last)
        columns = {n: given(rows.column(n).combine_chunks()) for n in rows.column_names}
        made = [r for a, b in zip(starts[:ends], starts[1 : ends + 1], strict=True) if (r := fn({n: c[a:b] for n, c in columns.items()})) is not None]
        held[:] = rows.slice(starts[ends]).to_batches() if not last else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*made, strict=True), fields, strict=True)], schema=fields)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
