"""The queries of the operators on text collections. Where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatherline.llm import (
    centroids,
    filter_audit,
    lang_id,
    minhash,
    mixing,
    packing,
    pieces,
    secrets,
    simhash,
    sql,
    suffix_dedup,
    toxicity,
    vector_dedup,
    word_counts,
)
from gatherline.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, same_as: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if same_as is not None:
            ORACLES[name] = same_as
        return fn

    return add


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_secrets")
def op1(spark, sf):
    return secrets.scan(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query("op2_suffix_dedup")
def op2(spark, sf):
    return suffix_dedup.removed(table(spark, sf, "documents"))


@query("op3_pieces")
def op3(spark, sf):
    return pieces.coded(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op4_packing")
def op4(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query("op5_simhash")
def op5(spark, sf):
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op6_minhash")
def op6(spark, sf):
    return minhash.fingerprints(table(spark, sf, "documents"))


@query("op7_token_counts")
def op7(spark, sf):
    return word_counts.token_counts(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op8_toxicity")
def op8(spark, sf):
    return toxicity.toxic(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_vectors")
def op9(spark, sf):
    return vector_dedup.linked(table(spark, sf, "embeddings"))


@query("op10_language")
def op10(spark, sf):
    return lang_id.identify(table(spark, sf, "documents"))


@query("op11_clusters", sql.clusters())
def op11(spark, sf):
    return centroids.clusters(table(spark, sf, "embeddings"))


@query("op12_mixing", sql.MIX)
def op12(spark, sf):
    return mixing.shares(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_filter_audit", sql.audit())
def op13(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
