"""Filter interaction audit: sorted lists of failing documents per part and filter, their unions and differences."""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.session import stored

WORDS_AT_LEAST, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
FILTERS = "ABCDE"
#: Texts with more than one in so many of all rows are joined by broadcast: there are fewer of them than this.
HEAVY = 1_000
_PARTS_HELD = 10_000


def row_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one document: few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < WORDS_AT_LEAST,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, fails (bit i is set when filter i fails) and text_key of each document.

    The last filter fails a document whose text some smaller doc_id has too, in the whole table; a row without a
    doc_id neither fails it nor makes others fail. Texts meet by their SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    bits = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(0) for f, c in row_filters(F.col("t")).items()), F.lit(0))
    rows, _ = stored(d.select("part", "doc_id", bits.alias("fails"), F.unhex(F.sha2("t", 256)).alias("text_key")))
    count = rows.count()
    first, _ = stored(rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("text_key", "first", "n"))
    heavy = F.col("n") * HEAVY > count
    marked = rows.join(F.broadcast(first.where(heavy).drop("n")), "text_key", "left")
    rare = marked.where("first is null").drop("first").join(first.where(~heavy).drop("n"), "text_key", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    both = marked.where("first is not null").unionByName(rare)
    return both.select("part", "doc_id", (F.col("fails") + copy).alias("fails"), "text_key")


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted lists merged: the new members of ``b`` leap to their places in ``a``."""
    if len(a) < len(b):
        a, b = b, a
    new = _minus(b, a)
    return np.insert(a, np.searchsorted(a, new), new)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The members of a sorted list that are not in another one."""
    if not len(a) or not len(b):
        return a
    at = np.searchsorted(b, a)
    return a[b[np.minimum(at, len(b) - 1)] != a]


def _slots(n: int) -> dict[tuple[int, int], int]:
    """A place for each (set of filters applied before, filter)."""
    return {(s, f): i for i, (s, f) in enumerate((s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1)}


def sizes_of(lists: list[np.ndarray], labelled: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """For each part (a stretch of ids between two bounds) and each (set, filter): how many the filter removes after the
    set, and how many of them each labelled list holds. Rows are parts; a labelled list's figures follow the removed ones.
    """
    n = len(lists)
    per_part = lambda ids: np.diff(np.searchsorted(ids, bounds))
    unions = [np.zeros(0, np.int64)]
    for s in range(1, 1 << n):
        top = s.bit_length() - 1
        unions.append(_union(unions[s ^ (1 << top)], lists[top]))
    out = []
    for s, f in _slots(n):
        gone = _minus(lists[f], unions[s])
        out.append([per_part(gone), *[per_part(gone) - per_part(_minus(gone, x)) for x in labelled]])
    return np.array(out, np.int64).transpose(2, 1, 0).reshape(len(bounds) - 1, -1)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: what each
    filter does at each step of each order, per source.

    Failing documents are range-sorted by doc_id; in a run of ids each filter has a sorted list of its failing ones per
    part (the parts of a run lie end to end). Unions over sets of filters and their differences are merged by leaps,
    and their sizes are summed over the runs, so a task holds one run and one row of sums a part.

    A null text is empty (no words; alike with other empty ones), a null source is the part ``''``. Rows without a
    doc_id count, fail E never and have no labels; repeated rows count each and are not copies of each other. A doc_id
    labelled more than once has the largest of its labels. Other columns are ignored. No documents, no rows.
    """
    flag = lambda c, name: F.coalesce(F.max(F.col(c).cast("int")) == 1, F.lit(False)).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality", "good"), flag("toxic", "toxic"))
    rows = failures(docs).join(known, "doc_id", "left")
    runs = rows.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id").select("part", "fails", "good", "toxic")
    n = len(FILTERS)
    width = 3 * len(_slots(n))

    def sums(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), pa.array([v[:1].tolist() + v[1:].tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "sizes"]
            )
            held.clear()
            return out

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code = np.asarray(parts.indices)
            order = np.argsort(code, kind="stable")  # parts end to end, ids ascending in each
            bounds = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
            fails = np.asarray(batch.column("fails"))[order]
            marks = [np.asarray(batch.column(c).fill_null(False).to_numpy(zero_copy_only=False), bool)[order] for c in ("good", "toxic")]
            got = sizes_of([np.flatnonzero(fails >> f & 1) for f in range(n)], [np.flatnonzero(m) for m in marks], bounds)
            for name, docs_here, row in zip(parts.dictionary.to_pylist(), np.diff(bounds), got, strict=True):
                held[name] = held.get(name, 0) + np.concatenate(([docs_here], row))
            if len(held) > _PARTS_HELD:
                yield flush()
        if held:
            yield flush()

    added = [F.sum(F.get("sizes", F.lit(i))).alias(f"s{i}") for i in range(width + 1)]
    totals = runs.mapInArrow(sums, "part string, sizes array<long>").groupBy("part").agg(*added)
    return totals.select("part", F.array(*[F.col(f"s{i}") for i in range(width + 1)]).alias("sizes")).mapInArrow(_report, SCHEMA)


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(batches):
    """The rows of each part, from its sizes: every order, every step."""
    n, slots = len(FILTERS), _slots(len(FILTERS))
    everything = (1 << n) - 1
    ways = {k: factorial(k) * factorial(n - 1 - k) for k in range(n)}
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), step, before, f))
            before |= 1 << f
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for part, sizes in zip(batch.column("part").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            docs, removed, good, toxic = sizes[0], *np.array(sizes[1:]).reshape(3, -1).tolist()
            gone = {0: 0}  # documents that fail any filter of a set
            for s in range(1, everything + 1):
                top = s.bit_length() - 1
                gone[s] = gone[s ^ (1 << top)] + removed[slots[s ^ (1 << top), top]]
            shapley = [sum(ways[s.bit_count()] * removed[i] for (s, g), i in slots.items() if g == f) for f in range(n)]
            rows = []
            for order, step, before, f in steps:
                i = slots[before, f]
                alone = removed[slots[everything ^ (1 << f), f]]
                rows.append((part, order, step, docs - gone[before | 1 << f], removed[i], removed[slots[0, f]] - removed[i], alone, good[i], toxic[i], shapley[f]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7, strict=True)], names
            )
