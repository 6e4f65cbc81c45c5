"""Document fingerprints: MinHash over word shingles with many universal hash functions, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.components import components, runs
from gatherline.llm.simhash import TILE, tiled
from gatherline.llm.texts import U64, blocks, encoded, mix, word_hashes
from gatherline.session import stored

HASHES = 128
WORDS = 5
BANDS, ROWS = 32, 4  # a pair at 0.8 meets in a band with probability 0.9999999
#: Odd multipliers: each permutes the 64-bit values.
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_STEP = 1 << 12


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """64-bit hashes of each text's shingles of lower-cased words; fewer words make one shingle, none make none."""
    h, firsts = word_hashes([encoded((t or "").lower()) for t in texts])
    x = h.copy()
    n = max(0, len(h) - words + 1)
    x = x[:n]
    for j in range(1, words):
        x = mix(x) * U64(0x9E3779B97F4A7C15) + h[j : n + j]
    x = mix(x)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(x[a : b - words + 1])
        else:
            one = U64(b - a)
            for v in h[a:b]:
                one = mix(np.array([one]))[0] ^ v
            out.append(mix(np.array([one])) if b > a else x[:0])
    return out


def signature(x: np.ndarray) -> np.ndarray:
    """16 bits of the least value under each hash function; all ones for a text without words."""
    if not len(x):
        return np.full(HASHES, 0xFFFF, np.uint16)
    least = (_MULTIPLIERS[:, None] * x[None, :_STEP]).min(1)
    for at in range(_STEP, len(x), _STEP):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * x[None, at : at + _STEP]).min(1))
    return (mix(least) & U64(0xFFFE)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places, which estimates the Jaccard similarity of the shingle sets."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of ``following``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """(slot, carried, doc_id, text): documents dealt into ranges of doc_id, each range sorted, and after each range
    the first document of the next one (carried); after the last range the first of all. Null ids come first.

    The ranges follow 256 quantiles of the ids, each cut evenly; only the least id of each range passes
    through the driver, and their number is that of the shuffle partitions.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse = min(256, slots)
    marks = d.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", F.lit([i / coarse for i in range(1, coarse)]) if coarse > 1 else F.array(F.lit(0.5)), F.lit(10_000)).alias("q")).first()
    edges = sorted({marks["lo"], *marks["q"]}) if marks["lo"] is not None else [0]
    fine = -(-slots // len(edges))
    arr = F.array(*[F.lit(e).cast("long") for e in edges])
    tops = F.array(*[F.lit(e).cast("long") for e in [*edges[1:], (marks["hi"] or 0) + 1]])
    part = F.size(F.filter(arr, lambda e: e <= F.col("doc_id"))) - 1
    share = (F.col("doc_id") - F.get(arr, part)) / (F.get(tops, part) - F.get(arr, part))
    slot = F.coalesce(part * fine + F.least(F.floor(share * fine), F.lit(fine - 1)), F.lit(-1)).cast("long")
    d = d.withColumn("slot", slot)
    least = d.groupBy("slot").agg(F.min("doc_id").alias("first")).orderBy("slot").collect()
    before = [(r["first"], least[i - 1]["slot"]) for i, r in enumerate(least)]
    carry = spark.createDataFrame(before, "first long, prior long")  # one row for each range
    moved = d.join(F.broadcast(carry), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("prior").alias("slot"), F.lit(True).alias("carried"))
    return d.withColumn("carried", F.lit(False)).unionByName(moved).repartition(slots, "slot").sortWithinPartitions("slot", "carried", F.asc_nulls_first("doc_id"), "text").select("text", "slot", "carried", "doc_id")


def fingerprints(docs: DataFrame, slots: int | None = None, words: int = WORDS) -> DataFrame:
    """The fingerprint of each document and of its edited text, and how alike they and the next document's are.

    The next document is the one after it by doc_id (ties by text; repeated rows each); after the last comes
    the first, so a single document follows itself. A null text is empty. Texts without words are alike.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the last document, its signature included

        for rows in blocks(batches, 1 << 19):
            own = [signature(x) for x in shingles([r[0] for r in rows], words)]
            pairs = []
            for (text, _, carried, doc), sig in zip(rows, own, strict=True):
                if held is not None:
                    pairs.append((held, text, sig))
                held = None if carried else (doc, text, sig)
            changed = [edited(h[1], text) for h, text, _ in pairs]
            out = []
            for (h, _, sig), new, x in zip(pairs, changed, shingles(changed, words), strict=True):
                e = signature(x)
                out.append((h[0], len(h[1]), hashlib.sha256(encoded(new)).hexdigest(), as_text(h[2]), as_text(e), likeness(h[2], e), likeness(h[2], sig)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, slots).mapInArrow(run, schema)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by a Jaccard similarity of ``threshold`` or more.

    Documents with equal shingle sets meet as one. Bands of the signature are the keys of the join; pairs that
    share a band are verified by their whole shingle sets, in tiles of bounded size, and give a spanning
    forest. Documents without an id have no class; those without words are one class.
    """

    def prints(batches):
        for rows in blocks(batches):
            sets = [np.unique(x) for x in shingles([r[0] for r in rows], words)]
            whole = [hashlib.md5(s.tobytes()).digest() for s in sets]
            bands = [mix(signature(s)[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) @ _MULTIPLIERS[:ROWS] + np.arange(BANDS, dtype=np.uint64)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int64()), pa.array(whole, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([b.tolist() for b in bands], pa.list_(pa.int64()))],
                ["doc_id", "whole", "set", "bands"],
            )

    d = docs.where("doc_id is not null").select(F.col("text").cast("string").alias("t"), F.col("doc_id").cast("long").alias("k"))
    each, _ = stored(d.mapInArrow(prints, "doc_id long, whole binary, set binary, bands array<long>"))
    low = each.groupBy("whole").agg(F.min("doc_id").alias("low"))
    heads, _ = stored(each.join(low, (each["whole"] == low["whole"]) & (each["doc_id"] == low["low"])).select("low", "set", "bands").dropDuplicates(["low"]))

    def verify(batches):
        for t in runs(batches):
            keys = t.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist(), len(keys)]
            ids, sets = t.column(1).to_numpy(), t.column(2)
            left, right = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                s = [np.frombuffer(v.as_py(), np.uint64) for v in sets.slice(lo, hi - lo)]
                rest = list(range(hi - lo))
                while rest:
                    front = [rest.pop(0)]
                    while front and rest:
                        i = front.pop()
                        near = [j for j in rest if _jaccard(s[i], s[j]) >= threshold]
                        left += [ids[lo + i]] * len(near)
                        right += [ids[lo + j] for j in near]
                        front += near
                        gone = set(near)
                        rest = [j for j in rest if j not in gone]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    root = components(tiled(heads.select(F.explode("bands").alias("k"), "low", "set"), "low", tile).mapInArrow(verify, "a long, b long"))
    return each.select("doc_id", "whole").join(low, "whole").join(root, F.col("low") == F.col("node"), "left").select("doc_id", F.coalesce("root", "low").alias("component_id"))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
