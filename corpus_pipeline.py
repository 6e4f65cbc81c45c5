"""The training corpus from documents: language, near-copies, repeated passages, secrets, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatherline.llm import lang_id, packing, secrets, simhash, suffix_dedup
from gatherline.llm.catalog import tokenizer
from gatherline.llm.texts import short_batches
from gatherline.session import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest goes."""
    short_batches(spark)
    return lang_id.confident(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    short_batches(spark)
    return simhash.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the byte strings that occur more than once."""
    short_batches(spark)
    return suffix_dedup.without_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked."""
    short_batches(spark)
    return secrets.redact(docs, tokenizer("word_bpe_49k.json"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    short_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL cannot express the models and fingerprints; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = stored(docs)
    return docs
