"""Byte searches over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.plans.tables import Registry, table
from quarry.sources.manifests import language_lines

R = Registry()


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


@R.add("SELECT doc_id, CASE WHEN position('ing' IN text) > 0 THEN strlen(substr(text, 1, position('ing' IN text) - 1)) ELSE -1 END AS found FROM documents")
def find_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("doc_id", scalars.find_forward(F.col("data"), F.lit(bytearray(b"ing"))).alias("found"))


@R.add("SELECT doc_id, CASE WHEN position('gni' IN reverse(text)) > 0 THEN strlen(text) - strlen(right(text, position('gni' IN reverse(text)) - 1)) - 3 ELSE -1 END AS found FROM documents")
def find_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("doc_id", scalars.find_backward(F.col("data"), F.lit(bytearray(b"ing")), F.octet_length("data")).alias("found"))


@R.add("SELECT doc_id, (strlen(text) - strlen(replace(text, 'enen', ''))) // 4 AS n_found FROM documents")
def find_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that don't overlap."""
    return _bytes(spark, sf_dir).select("doc_id", scalars.count_all(F.col("data"), F.lit(bytearray(b"enen"))).alias("n_found"))


@R.add("""WITH p AS (SELECT doc_id, unnest(string_split(text, 'stan')) AS part, generate_subscripts(string_split(text, 'stan'), 1) AS k, len(string_split(text, 'stan')) AS n FROM documents)
SELECT doc_id, k AS nth, found FROM (SELECT doc_id, k, n, CAST(sum(strlen(part) + 4) OVER (PARTITION BY doc_id ORDER BY k) - 4 AS BIGINT) AS found FROM p) WHERE k < n""")
def find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bytes(spark, sf_dir).select("doc_id", F.posexplode(scalars.find_all(F.col("data"), F.lit(bytearray(b"stan")))).alias("nth", "found"))
    return rows.select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), "found")


@R.add("""WITH d AS (SELECT doc_id, doc_id % 200 AS hint, CASE WHEN position('the ' IN text) > 0 THEN strlen(substr(text, 1, position('the ' IN text) - 1)) ELSE -1 END AS far, text FROM documents)
SELECT doc_id, CASE WHEN far < 0 THEN -1 ELSE far END >= 0 AS found FROM d""")
def locate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a signature is found at a hint, near it or anywhere (offsets and tiers are unit-tested)."""
    rows = _bytes(spark, sf_dir)
    at = scalars.locate(F.col("data"), F.lit(bytearray(b"the ")), F.col("doc_id") % 200, radius=64)
    return rows.select("doc_id", (at["offset"] >= 0).alias("found"))


@R.add("SELECT doc_id, md5(encode(text)[1:256]) AS signature, strlen(text) AS n_bytes FROM documents")
def signature_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 256 bytes of each payload as its track signature."""
    return _bytes(spark, sf_dir).select("doc_id", F.md5(F.substring("data", 1, 256)).alias("signature"), F.octet_length("data").cast("long").alias("n_bytes"))


@R.add("SELECT conv_id, turn, array_to_string(list_filter(string_split(replace(text, '. ', chr(10) || 'id: '), chr(10)), lambda x: x LIKE 'id: %'), chr(10)) AS lines FROM conversations")
def idx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit(". "), F.lit("\nid: "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", language_lines(text).alias("lines"))


@R.add("""SELECT p_partkey, CASE WHEN length(h) > 0 AND length(h) % 2 = 0 AND regexp_matches(h, '^[0-9A-Fa-f]+$') THEN upper(h) END AS bytes FROM
(SELECT p_partkey, replace(replace(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE to_hex(p_partkey * 7919) || '-' || lpad(CAST(p_partkey % 90 AS VARCHAR), 3, ' ') END, ' ', ''), '-', '') AS h FROM part)""")
def hex_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.hex(k * 7919), F.lit("-"), F.lpad((k % 90).cast("string"), 3, " ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(scalars.pattern(text, True)).alias("bytes"))
