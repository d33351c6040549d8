"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, minhash, mixing, pii, toxicity
from quarry.llm.common import cut, discard, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold of their language stay.

    Null and empty texts, and those without words, get the score of the bias
    alone and stay; a null language has the threshold of all; repeated rows go
    or stay together.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep_clean(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8.

    Rows with null doc_id, and those without words, belong to no group and all
    stay, but for repeated rows with a doc_id.
    """
    return minhash.keep_first(docs, n=5, over=80, of=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows.  A null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of source, language and topic; nulls are categories of their own."""
    return mixing.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the text decoded from them; a null text has no ids."""
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can't express the trained classifiers; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(before)  # a table of the stage before; the input's files aren't ours and stay
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
