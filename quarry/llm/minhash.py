"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact sets.

1. Each row gets its set of hashed word shingles, a digest of that set, and a
   signature of BANDS x ROWS minima.  Rows with equal sets form a class, which
   is one node from here on.
2. Nodes that agree in a band are candidates.  First, every member
   of a bucket is compared with the bucket's smallest member alone.  A
   signature is read in batches; with m matches in n, the posterior of
   similarity >= threshold is a binomial tail (uniform prior), and a pair
   under MISS is dropped.  Survivors are verified on the full sets, and
   verified links are joined to components.
3. Buckets that then still hold several components are compared pair by pair,
   in tiles, for members of different components; a pair that agrees in several
   bands counts in the first.  Members of the component of a bucket's smallest
   member are compared with the others alone, so that a large bucket with few
   others costs few tiles.  A tile is bounded in members and in shingles.  It
   names the members of its survivors; their full sets are then compared in the
   same tiles, exactly, and a tile emits one link for each member towards its
   local component, never the pairs.

Links are confirmed on the 64-bit hashes of all shingles of both documents.
Buckets are salted by their size where members meet what is known of a bucket.

No link between different components can be lost other than by the bands
(7e-8 at a similarity of 0.85, 1.5e-5 at 0.8) or by MISS.  Large groups of near
copies are joined in step 2 with one comparison for each member and band.

Nulls: a null text counts as empty; a set without shingles links with nothing.
A row with null doc_id gets a null component_id and is kept.  Repeated rows
each give a row with the same answer.  Rows of one doc_id with different texts
are each compared by their own text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, cut, discard, map_runs, map_texts
from quarry.llm.components import local_components, named_components

BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: Hashes of one batch of a signature; chance to drop a pair at the threshold.
STEP, MISS = 20, 1e-6
#: Members and shingles of a block, two of which make a tile; members of a bucket that meet in one task; shingles hashed at once.
TILE, HELD, SALT, PART = 512, 1 << 20, 4096, 2048
#: Shingles whose membership is held as a matrix at once.
COLUMNS = 8192

_rng = np.random.default_rng(20_011)
MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence, if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ h[j : len(words) - width + 1 + j]) * MIX[j % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> bytes:
    """HASHES minima, each as 16 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for b in range(0, len(hashes), PART):
        np.minimum(low, (hashes[b : b + PART, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return ((low * MIX[0]) >> np.uint64(48)).astype("<u2").tobytes()


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(hashes read, matches needed): fewer leave P(similarity >= threshold) under MISS.

    With a uniform prior, that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, need = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= MISS:
                need = m
                break
        out.append((n, need))
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prepared(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, class, text_md5, signature) of each row, written to the shared folder; class and signature are null without shingles."""

    def run(ids, texts):
        sets = [shingles(t, n) for t in texts]
        md5 = [b"" if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
        return [ids, [len(s) for s in sets], [set_digest(s) if len(s) else None for s in sets], md5, [signature(s) if len(s) else None for s in sets]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return cut(map_texts(docs.select(doc_id, text), run, f"id {kind}, n_shingles long, class binary, text_md5 binary, signature binary"))


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(id, hashes) of the nodes in wanted (id, doc, class), from a second read of texts, written to the shared folder.

    Most documents share no band with another; storing all sets would cost
    more than the texts do.  Texts move once, to the node of their doc_id; one
    that isn't of the node's class (its doc_id has several texts) is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                sets = [shingles(t, n) for t in part.column(2).to_pylist()]
                rows = [i for i, (c, s) in enumerate(zip(part.column(1).to_pylist(), sets, strict=True)) if set_digest(s) == c]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array([sets[i].tobytes() for i in rows], pa.binary())], names=["id", "hashes"])

    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(wanted.select("id", "doc", "class"), "doc").select("id", "class", "text")
    return cut(texts.mapInArrow(run, "id long, hashes binary"))


def survivors(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with signatures sa, sb that the posterior doesn't drop."""
    need = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
                rows, hits, before = np.arange(len(x)), np.zeros(len(x), dtype=int), 0
                for n, m in need:
                    hits = hits + (x[rows, before:n] == y[rows, before:n]).sum(axis=1)
                    rows, hits, before = rows[hits >= m], hits[hits >= m], n
                yield part.select(["a", "b"]).take(pa.array(rows))

    a, b = pairs.schema["a"].dataType.simpleString(), pairs.schema["b"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {a}, b {b}")


def verified(pairs: DataFrame, sets: DataFrame, over: int, of: int) -> DataFrame:
    """Pairs (a, b) whose sets have of * intersection >= over * union; sets: (id, hashes)."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if min(len(p), len(q)) * of < over * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if of * shared >= over * (len(both) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, type=pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def salted(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (bucket, id, m, ...) with what known has of their buckets (bucket, m, ...), at most about SALT members of a bucket in a task."""
    salts = F.ceil(F.col("m") / SALT).cast("int")
    left = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(9)), salts).cast("int"))
    right = known.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m")
    return left.join(right, ["bucket", "salt"]).drop("salt")


def tiled(open_rows: DataFrame, threshold: float) -> DataFrame:
    """Members of pairs of different components that survive within buckets: (bucket, i, j, own, id, comp).

    open_rows: (bucket, band, m, id, comp, signature), m the bucket's members;
    size, where there is one, the shingles of each.  The members of a bucket
    are cut into blocks by a hash: first those outside the component of its
    smallest member, then those inside.  A pair of blocks is a tile (i, j),
    unless both are inside, so that no task holds more than two blocks at once.
    A pair that agrees in an earlier band is left to that band's bucket.
    """
    need = least_matches(threshold)
    rows = open_rows if "size" in open_rows.columns else open_rows.withColumn("size", F.lit(1))
    main = rows.groupBy("bucket").agg(F.first("m").alias("m"), F.min_by("comp", "id").alias("main"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("bucket", "m", "main")
    rows = cut(salted(rows, main).withColumn("inside", F.col("comp") == F.col("main")))
    blocks = lambda own: F.ceil(F.greatest(F.sum(own.cast("long")) / TILE, F.sum(F.when(own, F.col("size")).otherwise(0)) / HELD)).cast("int")
    small = (F.count("*") <= TILE) & (F.sum("size") <= HELD)  # one block, which meets itself
    counts = rows.groupBy("bucket").agg(F.first("m").alias("m"), blocks(~F.col("inside")).alias("outer"), blocks(F.col("inside")).alias("inner"), small.alias("small"))
    key = F.xxhash64("id", F.lit(5))
    own = F.when(F.col("small"), 0).when(F.col("inside"), F.col("outer") + F.pmod(key, F.col("inner"))).otherwise(F.pmod(key, F.col("outer"))).cast("int")
    others = F.when(F.col("small"), 1).when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    dealt = salted(rows, counts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "signature")
    kind = open_rows.schema["id"].dataType.simpleString()

    def run(rows: dict) -> tuple | None:
        own, comp = rows["own"], rows["comp"]
        i, j, band = rows["i"][0], rows["j"][0], int(rows["band"][0])
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype="<u2").reshape(-1, HASHES)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        p, q = np.nonzero(comp[left][:, None] != comp[right][None, :])
        p, q = left[p], right[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        for b in range(band):
            met = np.ones(len(p), dtype=bool)
            for k in range(b * ROWS, (b + 1) * ROWS):
                met &= sign[p, k] == sign[q, k]
            p, q = p[~met], q[~met]
        hits, before = np.zeros(len(p), dtype=int), 0
        for n, m in need:
            for k in range(before, n):
                hits += sign[p, k] == sign[q, k]
            keep = hits >= m
            p, q, hits, before = p[keep], q[keep], hits[keep], n
        some = np.unique(np.concatenate([p, q]))
        return tuple(rows[c][some] for c in ("bucket", "i", "j", "own", "id", "comp")) if len(some) else None

    return map_runs(dealt, ["bucket", "i", "j"], run, f"bucket long, i int, j int, own int, id {kind}, comp {kind}")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product of membership matrices, over columns of shingles that two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.ravel()
    both = count[column] > 1
    owner, (names, column) = owner[both], np.unique(column[both], return_inverse=True)
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for b in range(0, len(names), COLUMNS):
        part = slice(*np.searchsorted(column, [b, b + COLUMNS]))
        member = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        member[owner[part], column[part] - b] = 1
        out += member @ member.T
    return out.astype(np.float64)


def tiled_links(members: DataFrame, sets: DataFrame, over: int, of: int) -> DataFrame:
    """Links (a, b) that join the members of each tile as all its exact links do: one for each member at most."""
    kind = members.schema["id"].dataType.simpleString()

    def run(rows: dict) -> tuple | None:
        order = np.argsort(rows["id"], kind="stable")
        held = rows["hashes"].to_pylist()
        ids, hashes = rows["id"][order], [np.frombuffer(held[k], dtype=np.uint64) for k in order]
        size, shared = np.array([len(v) for v in hashes]), shared_counts(hashes)
        p, q = np.nonzero(of * shared >= over * (size[:, None] + size[None, :] - shared))
        lab = local_components(len(ids), p, q)
        some = lab != np.arange(len(ids))
        return (ids[lab[some]], ids[some]) if some.any() else None

    return map_runs(members.join(sets, "id").select("bucket", "i", "j", "id", "hashes"), ["bucket", "i", "j"], run, f"a {kind}, b {kind}")


def labelled(docs: DataFrame, n: int, over: int, of: int, doc_id: str, text: str) -> DataFrame:
    """(id, text_md5, n_shingles, root, component_id) of each row.

    root is the same for the rows of one group and null for a row that links
    with nothing and has no copy known by its shingles (none, or a null id).
    """
    threshold = over / of
    rows = prepared(docs, n, doc_id, text)
    sized = rows.where("id is not null and class is not null")
    nodes = sized.groupBy("class").agg(F.min("id").alias("doc"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    bands = F.array(*(F.xxhash64(F.substring("signature", 1 + 2 * ROWS * b, 2 * ROWS), F.lit(b)) for b in range(BANDS)))
    placed = nodes.select("id", F.posexplode(bands).alias("band", "bucket"))
    buckets = cut(placed.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("m")).where("lead <> last").select("bucket", "lead", "m"))
    members = cut(placed.join(buckets, "bucket"))
    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    signed = lambda p: p.join(nodes.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(nodes.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")
    sets = full_sets(docs, nodes.join(members.select("id").distinct(), "id", "left_semi"), n, doc_id, text)
    links = cut(verified(survivors(signed(stars), threshold), sets, over, of))
    names = nodes.select(F.col("id").alias("node"), F.col("doc").alias("name"))
    joined = named_components(links, names)
    grouped = members.where("m > 2").join(joined.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "m", "id", F.coalesce("component", "id").alias("comp"))
    mixed = grouped.groupBy("bucket").agg(F.first("m").alias("m"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("bucket", "m")
    waiting = salted(grouped, mixed).join(nodes.select("id", "size", "signature"), "id")
    found = cut(tiled(waiting, threshold))
    more = cut(tiled_links(found, sets, over, of))
    if not more.isEmpty():
        discard(joined)
        joined = named_components(links.unionByName(more), names)
    discard(buckets, members, sets, found, links, more)
    named = nodes.select("id", "class", "doc").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("class", F.coalesce("component", "id").alias("root"), F.coalesce("name", "doc").alias("component_id"))
    out = rows.select("id", "text_md5", "n_shingles", "class").join(named, "class", "left")
    some = F.col("id").isNotNull()
    return out.select("id", "text_md5", "n_shingles", F.when(some, F.col("root")).alias("root"), F.when(some, F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 5, over: int = 80, of: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents are linked when of * intersection >= over * union of their sets
    of n-word shingles; component_id is the smallest doc_id reachable.
    """
    out = labelled(docs, n, over, of, doc_id, text)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, n: int = 5, over: int = 80, of: int = 100) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each group of near duplicates: by doc_id, then by the MD5 of its text.

    Repeated rows (same doc_id, same text) are one row, of which one stays.
    Different texts with one doc_id are judged by their own group each.  Rows
    with null doc_id, and without words, all stay, but for repeated ones.
    """
    rows = cut(labelled(docs, n, over, of, "doc_id", "text").where("id is not null").select("root", "id", "text_md5"))
    # The smallest of each group, found with partial minima; no row is joined by its group, which may be large.
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "text_md5")).alias("own")).select("own.id", "own.text_md5")
    stay = first.unionByName(rows.where("root is null").select("id", "text_md5"))
    packed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), F.coalesce(F.unhex(F.md5(F.encode(docs["text"], "UTF-8"))), F.lit(b"")).alias("text_md5"))
    known = packed.where("id is not null").join(stay, ["id", "text_md5"], "left_semi").dropDuplicates(["id", "text_md5"])
    return known.select("row.*").unionByName(packed.where("id is null").select("row.*"))
