"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.lang_id import held_out
from gatherline.llm.texts import NOT_ALNUM, U64, blocks, encoded, mix, word_hashes

BITS = 20
BIAS = 0  # the bucket of the constant feature
#: Labelled rows a model is fitted on, in expectation: those whose id hashes lowest.
FIT_ROWS = 24_000
_GAPS = (1, 2, 3)  # bigrams, and skip-grams over one and two words


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct buckets of each text's words, bigrams and skip-grams, sorted, with the bias bucket first."""
    h, firsts = word_hashes([encoded((t or "").lower()) for t in texts], NOT_ALNUM)
    shift = U64(64 - BITS)
    singles = mix(h + U64(1)) >> shift
    pairs = [mix(h[:-g] * U64(0x9E3779B97F4A7C15) + h[g:] + U64(g)) >> shift for g in _GAPS]
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        parts = [singles[a:b]] + [p[a : max(a, b - g)] for g, p in zip(_GAPS, pairs, strict=True)]
        out.append(np.unique(np.concatenate([np.array([BIAS], np.uint64), *parts])).astype(np.int32))
    return out


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> np.ndarray:
    """Weights after online passes over ``rows`` (buckets, label): a rate for each coordinate, L1 keeps them sparse."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    # the bias is not held back
    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weights(np.arange(1 << BITS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the regression, learned from about ``fit_rows`` labelled documents.

    A document counts as toxic if any of its label rows says so; null labels and ids, and labels without a
    document, teach nothing. The sample is one task's online pass, at every size of the input. Without a
    labelled row all weights are zero. Never more than 2**BITS weights reach the driver.
    """
    y = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    n = y.count()
    w = np.zeros(1 << BITS)
    if not n:
        return w
    draw = F.xxhash64("k", F.lit("toxicity sample")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = y.where(draw < min(1.0, fit_rows / n))  # bounded by fit_rows, whatever the input: safe to broadcast
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("t")).join(F.broadcast(sample), "k")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending")])
        order = np.argsort(mix(table.column("k").to_numpy().astype(np.uint64)), kind="stable")
        buckets = []
        for block in blocks(table.select(["t", "y"]).to_batches(1_000)):
            buckets += zip(features([r[0] for r in block]), [r[1] for r in block], strict=True)
        found = ftrl([buckets[i] for i in order])
        at = np.flatnonzero(found)
        return pa.table({"b": at.astype(np.int32), "w": found[at]})

    fitted = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(train, "b int, w double").toPandas()
    w[fitted["b"]] = fitted["w"]
    return w


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability that a document is toxic. Null and blank texts get that of the bias alone."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches):
        at, some = shared.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = some
        for rows in blocks(batches):
            s = np.array([w[f].sum(dtype=np.float64) for f in features([r[0] for r in rows])])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], ["key", "score"])

    return docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k")).mapInArrow(run, "key long, score double")


def toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row, learned outside the held-out fold."""
    known = labels.where(~held_out("doc_id", folds, fold))
    out = score(docs, fit(docs.select("doc_id", "text"), known))
    return out.select(F.col("key").alias("doc_id"), held_out("key", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
