"""Removal of long repeated byte strings: content-dealt shards, each with a suffix array and permuted common prefixes.

Every window of WIDTH bytes has one anchor, its substring of GRAM bytes with the least hash (the first of
equals), so equal windows have equal anchors wherever they are. A run of windows with the same anchor is a
segment; its bytes are its context. Contexts are dealt into shards by anchor, equal contexts once with their
number; a suffix array of the shard then finds every window that begins twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gatherline.llm.components import runs
from gatherline.llm.suffix_arrays import repeated_windows
from gatherline.llm.texts import U64, blocks, encoded, lean, mix, range_hashes, whole_rows
from gatherline.session import stored

WIDTH = 200
GRAM = 16
#: Bytes of contexts that one suffix array is built over.
SHARD_BYTES = 1 << 19
#: Contexts of one anchor from which on its windows are dealt out by their own hashes instead; so many hold 1.6 MB at most.
HOT_CONTEXTS = 4_096
_PLACE = U64((1 << 21) - 1)


def _first_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    x = np.frombuffer(data + b"\0" * GRAM, np.uint8)
    words = np.lib.stride_tricks.as_strided(x[:8].view(np.uint64), (len(data) + 8,), (1,))
    return mix(words[: len(data)] * U64(0x9E3779B97F4A7C15) + mix(words[8 : len(data) + 8]))


def segments(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, anchor hash, context hash) of all segments, in slices of bounded size."""
    from xxhash import xxh3_64_intdigest

    step = 1 << 20
    group, size = [], 0
    slices = [(i, a, t[a : a + step + width - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - width + 1), step) if len(t) >= width]
    for n, (i, a, part) in enumerate(slices):
        group.append((i, a, part))
        size += len(part)
        if size < step and n + 1 < len(slices):
            continue
        data = b"".join(g[2] for g in group)
        lengths = np.array([len(g[2]) for g in group])
        h = _gram_hashes(data)
        least = _first_least((h & ~_PLACE) | np.arange(len(data), dtype=np.uint64), width - GRAM + 1)
        place = (least & _PLACE).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = ends - lengths
        first, owner = [], []
        for k, (lo, n_windows) in enumerate(zip(begin.tolist(), (lengths - width + 1).tolist(), strict=True)):
            p = place[lo : lo + n_windows]
            cuts = np.flatnonzero(p[1:] != p[:-1]) + 1
            first += [np.array([lo]), cuts + lo]
            owner.append(np.full(len(cuts) + 1, k))
        first, owner = np.concatenate(first), np.concatenate(owner)
        last = np.append(first[1:], 0)
        closing = np.append(owner[1:] != owner[:-1], True)
        last[closing] = (ends - width + 1)[owner[closing]]
        contexts = np.array([xxh3_64_intdigest(data[a_:b_ + width - 1]) for a_, b_ in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
        number = np.array([g[0] for g in group])[owner]
        start = first - begin[owner] + np.array([g[1] for g in group])[owner]
        yield number, start, last - first, h[place[first]], contexts
        group, size = [], 0


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, text and two hashes that stand for the row; rows alike in both are one row's repeats."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("j1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("j2"))


def _segment_rows(d: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for rows in blocks(batches, 1 << 20):
            keys = np.array([(r[1], r[2]) for r in rows], np.int64)
            for number, start, n, anchor, context in segments([encoded(r[0]) for r in rows], width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (keys[number, 0], keys[number, 1], (start << 8) | n, anchor.view(np.int64), context.view(np.int64))], ["j1", "j2", "pn", "a", "c"]
                )

    return d.select("text", "j1", "j2").mapInArrow(lean(run), "j1 long, j2 long, pn long, a long, c long")


def repeated_ranges(d: DataFrame, width: int = WIDTH, hot: int = HOT_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(j1, j2, lo, hi): byte ranges of rows of ``d`` (from _keyed) that are covered by windows that begin twice."""
    rows = _segment_rows(d, width)
    seen = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("a", (F.col("c0") != F.col("c1")).alias("mixed"))
    seen, _ = stored(seen)  # read from a table, the join below can split a hot anchor's rows
    twice, _ = stored(rows.join(seen, "a"))
    start, windows = F.shiftright("pn", 8), F.col("pn").bitwiseAND(F.lit(255))
    # one context and several places: all its windows begin again
    sure = twice.where(~F.col("mixed")).select("j1", "j2", start.alias("lo"), (start + windows + (width - 1)).alias("hi"))
    mixed = twice.where("mixed")
    each = mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("j1", "j2", "pn")).alias("at"))
    number = each.groupBy("a").agg(F.count("*").alias("d"))
    wanted = each.join(number, "a").groupBy("at.j1", "at.j2").agg(F.collect_list(F.struct("a", "c", "at.pn", "n", "d")).alias("parts"))
    contexts, _ = stored(_contexts(d.join(wanted, ["j1", "j2"]), width))
    found = _by_suffix_arrays(contexts.where(F.col("d") <= hot), width, shard_bytes).unionByName(_by_windows(contexts.where(F.col("d") > hot), width))
    found, _ = stored(found)
    rest = mixed.join(found, ["a", "c"]).select("j1", "j2", (start + F.col("lo")).alias("lo"), (start + F.col("hi") + (width - 1)).alias("hi"))
    return sure.unionByName(rest)


def _contexts(joined: DataFrame, width: int) -> DataFrame:
    """(a, c, n, d, bytes) of the wanted segments, cut from their texts."""

    def run(batches):
        for rows in blocks(batches, 1 << 20):
            out = []
            for text, parts in rows:
                data = encoded(text)
                out += [(p["a"], p["c"], p["n"], p["d"], data[(at := p["pn"] >> 8) : at + (p["pn"] & 255) + width - 1]) for p in parts]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[i : i + 20_000], strict=True)], ["a", "c", "n", "d", "bytes"])

    return joined.select("text", "parts").mapInArrow(lean(run), "a long, c long, n long, d long, bytes binary")


def _may_share(parts: list[bytes], anchors: np.ndarray, width: int) -> np.ndarray:
    """Whether a context may share a window with another one of its anchor.

    Equal windows have their anchor in the same place, and half of the rest or more lies before or after it. So contexts
    with a common window agree in that many bytes before the anchor or after it.
    """
    side = -(-(width - GRAM) // 2)
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    data = b"".join(parts)
    found = np.flatnonzero(_gram_hashes(data) == np.repeat(anchors.view(np.uint64), lengths))
    place = found[np.searchsorted(found, ends - width)]  # the first one from the last window's start on
    x = np.frombuffer(data, np.uint8)
    may = np.zeros(len(parts), bool)
    for lo, hi, some in ((place - side, place, place - side >= begins), (place + GRAM, place + GRAM + side, place + GRAM + side <= ends)):
        some = np.flatnonzero(some)
        key = mix(range_hashes(x, lo[some], hi[some]) ^ mix(anchors[some].view(np.uint64)))
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        may[some[n[which] > 1]] = True
    return may


def _by_suffix_arrays(contexts: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """(a, c, lo, hi): runs of windows, counted from the context's start, that begin twice."""

    def run(batches):
        a, c, n, parts, size = [], [], [], [], 0

        def shard():
            out = []
            for ai, ci, ni, hit in zip(a, c, n, repeated_windows(parts, width), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit | (ni > 1), [False])).view(np.int8)))
                out += [(ai, ci, lo, hi) for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "c", "lo", "hi"])

        for t in runs(batches):
            keys = t.column("a").to_numpy()
            may = _may_share(t.column("bytes").to_pylist(), keys, width)
            alone = t.filter(pa.array(~may & (t.column("n").to_numpy() > 1)))
            if alone.num_rows:  # all their windows begin again, in other places with the same context
                sizes = pc.binary_length(alone.column("bytes")).to_numpy().astype(np.int64)
                cells = [alone.column("a").combine_chunks(), alone.column("c").combine_chunks(), pa.array(np.zeros(len(sizes), np.int64)), pa.array(sizes - (width - 1))]
                yield pa.RecordBatch.from_arrays(cells, ["a", "c", "lo", "hi"])
            t, keys = t.filter(pa.array(may)), keys[may]
            cuts = [*np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist(), len(keys)] if len(keys) else [0]
            cc, nn, bb = (t.column(x).to_pylist() for x in ("c", "n", "bytes"))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                a += keys[lo:hi].tolist()
                c += cc[lo:hi]
                n += nn[lo:hi]
                parts += bb[lo:hi]
                size += sum(map(len, bb[lo:hi]))
                if size >= shard_bytes:
                    yield from shard()
                    a, c, n, parts, size = [], [], [], [], 0
        if parts:
            yield from shard()

    return contexts.select("a", "c", "n", "bytes").repartition("a").sortWithinPartitions("a").mapInArrow(lean(run), "a long, c long, lo long, hi long")


def _by_windows(contexts: DataFrame, width: int) -> DataFrame:
    """The same for anchors with too many contexts for one task: their windows are counted one by one, by 128-bit hashes."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                out = [(r["a"], r["c"], r["n"], i, xxh3_128_digest(r["bytes"][i : i + width])) for r in rows for i in range(len(r["bytes"]) - width + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "c", "n", "i", "w"])

    windows = contexts.select("a", "c", "n", "bytes").mapInArrow(lean(run), "a long, c long, n long, i long, w binary")
    twice = windows.groupBy("w").agg(F.sum("n").alias("s")).where("s > 1").select("w")
    return windows.join(twice, "w").select("a", "c", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))


def _kept(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``data`` without the ranges, and the number of maximal removed runs."""
    kept, at, spans = [], 0, 0
    end = -1
    for lo, hi in sorted(ranges):
        if lo > end:
            spans += 1
            kept.append(data[at:lo])
        end = max(end, hi)
        at = end
    kept.append(data[at:])
    return b"".join(kept), spans


def _with_ranges(d: DataFrame, width: int, **options) -> DataFrame:
    ranges = repeated_ranges(d, width, **options).groupBy("j1", "j2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    return d.join(ranges, ["j1", "j2"], "left").select("text", "doc_id", "j1", "j2", "ranges")


def removed(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, repeated rows each.

    All bytes that a ``width``-byte string covers which begins anywhere else too go, in every place; strings
    are judged on the input. A null text is empty; a text under ``width`` bytes loses nothing.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for rows in blocks(batches, 1 << 21):
            out = []
            for text, doc, ranges in rows:
                data = encoded(text)
                kept, spans = _kept(data, [(r["lo"], r["hi"]) for r in ranges or ()])
                out.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names)

    d = _keyed(docs, text, key).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_ranges(d, width, **options).select("text", "doc_id", "ranges").mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """``docs`` (doc_id, text and n_chars among its columns) with repeated strings cut from the texts.

    Every row stays, if need be with an empty text; a character that lost some of its bytes goes whole.
    """

    d = docs.select(whole_rows(docs, "text", "n_chars").alias("rest_"), "text", F.xxhash64("doc_id", "text").alias("j1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("j2"))
    ranges = repeated_ranges(d.select("text", "j1", "j2"), width, **options).groupBy("j1", "j2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    joined = d.join(ranges, ["j1", "j2"], "left")
    source = joined.select("text", "rest_", "ranges")

    def rewrite(batches):
        for batch in batches:
            texts = []
            for t, ranges in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(None if t is None else _kept(encoded(t), [(r["lo"], r["hi"]) for r in ranges or ()])[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["rest_", "text"])

    out = source.mapInArrow(lean(rewrite), StructType([source.schema["rest_"], StructField("text", StringType())]))
    cells = {c: F.col(f"rest_.`{c}`") for c in docs.columns if c not in ("text", "n_chars")}
    cells |= {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[cells[c].alias(c) for c in docs.columns])
