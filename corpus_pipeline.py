"""The training-corpus pipeline: reject toxic documents, keep one of each near-duplicate group, redact personal data, mix
sources to target weights, encode. Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, jaccard, mixing, pii, toxicity
from brindle.llm.common import materialise, release, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from these documents and the labels table."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more."""
    return jaccard.distinct(docs, width=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with ``[KIND]`` in place of personal data."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.apply(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens of every row."""
    return bpe.encode_table(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Learned models, similarity groups and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each reads what its predecessor wrote, which goes once it is read.

    doc_id, ids and n_tokens of every document kept, as often as the mix takes it. Null ids and repeated rows are
    documents like others (of equal rows one stays, unless they have no words); null texts go with the mix, which takes
    words. An empty table gives no rows; without labels nothing is rejected. Other columns are carried to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
