"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Vectors of a label that agree in all sign bits of a table are candidates.
Equal vectors of a label are one class first, with its size.  Buckets are cut
into blocks, and each pair of blocks is a tile: the task that gets it computes
all its cosines in double precision at once, counts links, and emits for each
vector its number of links and one link towards the tile's local component:
never the pairs.  A pair that meets in several tables counts in the first one.

The number of sign bits grows with the largest label, the number of tables
with the bits, so that a pair at the threshold is missed with probability MISS
at most.

Nulls: vectors that are null, zero, or hold null or non-finite components, and
rows with null label, link with nothing.  A null vec_id gets null component_id
and is kept; it counts as a link of the others.  Repeated rows each give a
row, and count as other vectors.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, discard, map_runs
from quarry.llm.components import local_components, named_components

MISS, TILE, SEED = 1e-5, 512, 31_337


#: Parts into which what is known of a bucket is dealt, to meet its vectors.
SALTS = 8


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """Sign bits and tables for labels of at most so many vectors."""
    bits = max(8, min(24, math.ceil(math.log2(max(largest, 1) / 16 + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, bits * tables))


def hashed(vectors: DataFrame, bits: int, tables: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, class, codes, vector) of each row; class and codes are null where nothing may link.

    Codes take as many bytes for each table as its bits need, vectors those of
    the input's components.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    code_bytes, stored = -(-bits // 8), component_type(vectors, embedding)
    held: dict[int, np.ndarray] = {}
    powers = 1 << np.arange(bits)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                key, codes, raw = [], [], []
                for v, tag in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    x = np.array(v, dtype=np.float64) if v and tag is not None and None not in v else np.zeros(1)
                    # Lengths are scaled first, so that squares neither overflow nor vanish.
                    top = np.abs(x).max()
                    if not np.isfinite(top) or top == 0:
                        key.append(None), codes.append(None), raw.append(None)
                        continue
                    if len(x) not in held:
                        held[len(x)] = planes(len(x), bits, tables)
                    signs = ((x / top) @ held[len(x)] > 0).reshape(tables, bits)
                    key.append(xxhash.xxh3_128_digest(f"{tag} {len(x)} ".encode() + x.tobytes()))
                    codes.append((signs @ powers).astype("<u4").view(np.uint8).reshape(tables, 4)[:, :code_bytes].tobytes())
                    raw.append(x.astype(stored).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast("string"), pa.array(key, pa.binary()), pa.array(codes, pa.binary()), pa.array(raw, pa.binary())], names=["id", "label", "class", "codes", "vector"])

    return vectors.select(vec_id, embedding, label).mapInArrow(run, f"id {kind}, label string, class binary, codes binary, vector binary")


def component_type(vectors: DataFrame, embedding: str) -> str:
    """How a vector's components are stored: as they come, if they are floats."""
    return "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"


def tile(rows: dict, threshold: float, stored: str = "<f8", code_bytes: int = 4) -> tuple | None:
    """Links within one tile: (id, n, to); n counts vectors linked here first, to is in the same local component."""
    i, j, t = int(rows["i"][0]), int(rows["j"][0]), int(rows["t"][0])
    order = np.argsort(rows["id"], kind="stable")
    ids, own, size = rows["id"][order], rows["own"][order], rows["size"][order]
    width = int(rows["width"][0]) // np.dtype(stored).itemsize
    x = np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=stored).reshape(-1, width)[order].astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    left, right = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    p, q = np.nonzero(x[left] @ x[right].T >= threshold)
    p, q = left[p], right[q]
    if i == j:
        p, q = p[p < q], q[p < q]
    if len(p) and t:
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint8).reshape(len(ids), t, code_bytes)[order]
        for s in range(t):  # met in an earlier table
            new = (codes[p, s] != codes[q, s]).any(axis=1)
            p, q = p[new], q[new]
    if not len(p):
        return None
    n = np.bincount(p, size[q], len(ids)) + np.bincount(q, size[p], len(ids))
    to, some = local_components(len(ids), p, q), n > 0
    return ids[some], n[some].astype(np.int64), ids[to[some]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    largest = vectors.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count")).first()[0] or 1
    bits, tables = tables_for(largest, threshold)
    rows = cut(hashed(vectors, bits, tables, vec_id, embedding, label))
    # A class is one node under a number of its own, since a vec_id may come with several vectors.
    nodes = rows.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("label", "codes", "vector")))
    sizes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("size"))
    nodes = nodes.join(sizes, "class").withColumns({"id": F.monotonically_increasing_id(), "width": F.octet_length("vector")})
    nodes = cut(nodes.select("id", "class", "least", "size", "label", "width", "codes", "vector"))
    code_bytes, stored = -(-bits // 8), component_type(vectors, embedding)
    code = F.substring("codes", F.lit(1) + F.col("t") * code_bytes, F.lit(code_bytes))
    spots = nodes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    spots = spots.select("id", "t", F.xxhash64("label", "width", "t", code).alias("bucket"), "label", "width")
    full = cut(spots.groupBy("bucket", "t", "label", "width").agg(F.count("*").alias("m")).where("m > 1").select("bucket", "t", "m"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = spots.select("id", "t", "bucket", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS)).cast("int").alias("salt")).join(full.withColumn("salt", salt), ["bucket", "t", "salt"])
    dealt = dealt.withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    # Ids alone went to the buckets; a vector and the codes of the tables before this one join them for the tile.
    dealt = dealt.join(nodes.drop("class", "least"), "id").select("bucket", "t", "i", "j", "own", "id", "size", "label", "width", F.substring("codes", F.lit(1), F.col("t") * code_bytes).alias("codes"), "vector")
    met = cut(map_runs(dealt, ["label", "width", "bucket", "t", "i", "j"], lambda g: tile(g, threshold, stored, code_bytes), "id long, n long, to long"))
    linked = cut(met.groupBy("id").agg(F.sum("n").alias("n")))
    named = nodes.select("id", "class", "least", "size")
    joined = named_components(met, named.select(F.col("id").alias("node"), F.col("least").alias("name")), "id", "to")
    discard(full, met)
    top = named.join(linked, "id", "left").join(joined.select(F.col("node").alias("id"), F.col("name").alias("smallest")), "id", "left")
    top = top.select("class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    out = rows.select("id", "class").join(top, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
