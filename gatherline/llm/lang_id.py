"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatherline.llm.texts import blocks, lean, whole_rows

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Documents of each language that a model is fitted on, in expectation. Rarer languages are taken whole.
FIT_ROWS = 4_000
UNKNOWN = "und"
_PAD = max(ORDERS) - 1
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams (orders by positions), the first position of each text, and whether it has a letter.

    Texts are lower-cased; all but letters counts as a space, and each text ends in spaces, so that
    what a text gives does not depend on its neighbours.
    """
    codes, lengths = [], []
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes += [c, np.full(_PAD, 32, np.uint32)]
        lengths.append(len(c) + _PAD)
    letters = _letter_table()
    c = np.concatenate(codes)
    is_letter = letters[c]
    c = np.where(is_letter, c, np.uint32(32))
    firsts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    with_letter = np.logical_or.reduceat(is_letter, firsts)
    n = len(c) - _PAD
    out = np.empty((len(ORDERS), len(c)), np.uint32)
    for k, order in enumerate(ORDERS):
        x = c * np.uint32(_FACTORS[0]) + np.uint32(order)
        for j in range(1, order):
            x[:n] = (x[:n] ^ (x[:n] >> np.uint32(15))) * np.uint32(_FACTORS[j]) + c[j : n + j]
        x = (x ^ (x >> np.uint32(16))) * np.uint32(_FACTORS[3])
        out[k] = x >> np.uint32(16)
    ends = firsts + np.array(lengths)
    out[:, np.concatenate([ends - 1 - j for j in range(_PAD)])] = BUCKETS  # these would reach into the next text
    return out, firsts, with_letter


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, alpha: float = 0.1):
    """Languages (sorted) and the matrix of log probabilities, a row for each bucket; learned from a bounded sample.

    The priors are the shares of all rows. About ``fit_rows`` documents of a language are read, those whose
    key hashes lowest. Rows with a null text or language teach nothing. Without a row there are no languages.
    The result is bounded by BUCKETS times the number of languages.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(key).alias("k")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None
    share = F.create_map(*[x for s in langs for x in (F.lit(s), F.lit(min(1.0, fit_rows / sizes[s])))])
    draw = (F.xxhash64("k", F.lit("language sample")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    sample = rows.where(draw < F.element_at(share, F.col("l"))).select("t", "l")
    at = {s: i for i, s in enumerate(langs)}

    def count(batches):
        sums = np.zeros((len(langs), BUCKETS))
        for rows in blocks(batches, 1 << 19):
            for s in {r[1] for r in rows}:
                g, _, _ = grams([r[0] for r in rows if r[1] == s])
                sums[at[s]] += np.bincount(g.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        i, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[i, b])], ["i", "b", "n"])

    counts = sample.mapInArrow(count, "i int, b int, n double").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
    m = np.full((BUCKETS, len(langs)), alpha)
    m[counts["b"], counts["i"]] += counts["n"]
    m = np.log(m / m.sum(0))
    prior = np.log(np.array([sizes[s] for s in langs], float) / sum(sizes.values()))
    # only differences between languages count: centred values stay small and exact in single precision
    m = np.vstack([m - m.mean(1, keepdims=True), np.zeros((1, len(langs)))])
    return langs, (m.astype(np.float32), prior)


def _predict(rows_text: list[str | None], langs: list[str], fitted) -> tuple[list[str], np.ndarray]:
    preds, scores = [UNKNOWN] * len(rows_text), np.zeros(len(rows_text))
    if langs and rows_text:
        logp, prior = fitted
        g, firsts, with_letter = grams([t or "" for t in rows_text])
        sums = np.tile(prior, (len(rows_text), 1))
        for order in g:
            sums += np.add.reduceat(logp[order], firsts, axis=0, dtype=np.float64)
        best = sums.argmax(1)
        post = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        for i in np.flatnonzero(with_letter):
            preds[i], scores[i] = langs[best[i]], post[i]
    return preds, scores


def score(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row; score is the posterior of that language.

    A null text, one without a letter, or a model without languages gives ``und`` and 0. Other columns do not matter.
    """
    langs, fitted = model
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for rows in blocks(batches, (1 << 20) // max(4, len(langs))):
            preds, scores = _predict([r[0] for r in rows], langs, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(preds, pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    source = docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k"))
    return source.mapInArrow(run, "key long, lang_pred string, score double")


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether the check sum of the key, as text, falls in the held-out fold; a null key does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the rows outside the held-out fold.

    Repeated rows are scored each; a row with a null doc_id counts as held out and is scored all the same.
    """
    d = docs.select("doc_id", "text", "lang")
    model = fit(d.where(~held_out("doc_id", folds, fold)))
    out = score(d, model)
    return out.select(F.col("key").alias("doc_id"), held_out("key", folds, fold).alias("held_out"), "lang_pred", "score")


def confident(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with ``min_score`` or more; all columns stay."""
    langs, fitted = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    source = docs.select(F.col("text").cast("string").alias("t"), whole_rows(docs).alias("row_"))

    def run(batches):
        for batch in batches:
            keep = []
            for rows in blocks([batch.select([0])], (1 << 20) // max(4, len(langs))):
                preds, scores = _predict([r[0] for r in rows], langs, shared.value)
                keep += [p != UNKNOWN and s >= min_score for p, s in zip(preds, scores, strict=True)]
            yield batch.select([1]).filter(pa.array(keep, pa.bool_()))

    out = source.mapInArrow(lean(run), StructType([source.schema["row_"]]))
    return out.select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
