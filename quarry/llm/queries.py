"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import audio, bpe, chat, langid, license_scan, minhash, mixing, pii, toxicity, vectors
from quarry.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.weighted(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_p", 6).alias("p"), F.col("_taken").alias("taken"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.ordered(chat.link(table(spark, sf_dir, "conversations")))).drop("text")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, over=85, of=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.scores(docs, net)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, net).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_vector_neardup, op3_mixing, op4_license, op5_audio, op6_bpe, op7_chat, op8_minhash, op9_toxicity, op10_langid)
}
ORACLES: dict[str, str] = {"op3_mixing": mixing.oracle(), "op4_license": license_scan.oracle(), "op7_chat": chat.oracle()}
