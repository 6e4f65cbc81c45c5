"""SimHash near-duplicates: fingerprints of word shingles, linked through shared blocks of bits."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.components import components, runs
from gatherline.llm.texts import blocks, encoded, lean, mix
from gatherline.session import stored

BITS = 64
SEED = 42
#: Fingerprints with the same blocks that are compared in one task; fuller buckets are cut in tiles.
TILE = 8_192
#: Mean number of fingerprints in a bucket from which on finer blocks are used.
FULL = 4_096
#: Whole shingle sets that are compared in one task.
SET_TILE = 512


def fingerprint(text: str | None, words: int = 4, slab: int = 1 << 16) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    parts = encoded(text).lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxh64_intdigest(b" ".join(parts), SEED)]
        return _majority([np.array(hashes, "<u8")], 1)
    data = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1]
    ends = ends[words - 1 :]
    n = len(starts)
    return _majority(
        (np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[i : i + slab].tolist(), ends[i : i + slab].tolist(), strict=True)], "<u8") for i in range(0, n, slab)), n
    )


def _majority(hashes, n: int) -> int:
    counts = np.zeros(BITS, np.int64)
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each document as a signed long. Null and blank texts have 0."""

    def run(batches):
        for rows in blocks(batches, 1 << 22):
            fps = np.array([fingerprint(r[0], words) for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(fps)], ["key", "fp"])

    return docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k")).mapInArrow(run, "key long, fp long")


def _layout(n: int, distance: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bit edges of the blocks, and the sets of blocks that are keys: two close fingerprints agree on one set at least."""
    for extra in range(1, 5):
        count = distance + extra
        edges = [round(i * BITS / count) for i in range(count + 1)]
        if n >> (extra * BITS // count) <= FULL or extra == 4:
            break
    return edges, list(combinations(range(count), extra))


def links(prints: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span the same components as all
    pairs at ``distance`` or fewer differing bits.

    Pigeonhole: the bits are cut in more blocks than may differ, so a close pair agrees on whole blocks.
    Buckets of equal blocks are compared in numpy and give a spanning forest, never all their pairs. A bucket
    with more than ``tile`` rows is dealt into tiles, and each pair of tiles meets once, in a task of its own.
    """
    n = prints.count()
    edges, keys = _layout(n, distance)

    def block_key(which: int, blocks_: tuple[int, ...]):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in blocks_)
        mask -= (mask >> 63) << 64
        return F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(which))

    dealt = prints.select(F.explode(F.array(*[block_key(i, k) for i, k in enumerate(keys)])).alias("k"), "fp")

    def compare(batches):
        for t in runs(batches):
            a, b = near_links(t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tiled(dealt, "fp", tile).mapInArrow(compare, "a long, b long")


def tiled(dealt: DataFrame, node: str, tile: int) -> DataFrame:
    """``dealt`` (k, ...) laid out by k, sorted; buckets with more than ``tile`` rows are cut into tiles of
    about that many, and every pair of tiles becomes a bucket with a key of its own."""
    hot = dealt.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("k", F.ceil(F.col("n") / tile).cast("long").alias("tiles"))
    rest = [c for c in dealt.columns if c != "k"]
    key = F.when(F.col("tiles") == 1, F.col("k")).otherwise(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")))
    return (
        dealt.join(hot, "k", "left")
        .select("k", *rest, F.coalesce("tiles", F.lit(1)).alias("tiles"))
        .withColumn("own", F.pmod(F.xxhash64(node, F.lit("tile")), F.col("tiles")))
        .select("k", *rest, "tiles", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
        .select(key.alias("k"), *rest)
        .repartition("k")
        .sortWithinPartitions("k")
    )


def near_links(keys: np.ndarray, fps: np.ndarray, distance: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys: all close pairs of short runs, a spanning forest of longer ones."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    left, right = [], []
    rows = np.repeat(size <= small, size)
    k, f = keys[rows], fps[rows]
    for s in range(1, min(small, int(size[size <= small].max(initial=1)))):
        hit = np.flatnonzero((k[s:] == k[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= distance))
        left.append(f[hit])
        right.append(f[hit + s])
    for at, n in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
        rest = fps[at : at + n]
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                near = np.bitwise_count(front[:256, None] ^ rest[None, :]) <= distance
                hit = near.any(0)
                left.append(front[:256][near.argmax(0)[hit]])
                right.append(rest[hit])
                front = np.concatenate((front[256:], rest[hit]))
                rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def classes(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable through links, of every row.

    Rows with the same fingerprint are one class, so copies meet once. A null doc_id is never smallest: a
    component of such rows alone has a null component_id.
    """
    prints, _ = stored(fingerprints(docs, words))
    each, _ = stored(prints.groupBy("fp").agg(F.min("key").alias("low")))
    root = components(links(each.select("fp"), distance))
    each = each.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    each, _ = stored(each)
    low = each.groupBy("root").agg(F.min("low").alias("component_id"))
    labels, _ = stored(each.join(low, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select(F.col("key").alias("doc_id"), "fp", "component_id")


def as_hex(fp: str) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


WIDE = 8  # 64-bit words of a wide fingerprint: 512 bits estimate a similarity to about 0.02
_LOW_BITS = np.uint64(0x0101010101010101)


def wide_fingerprint(shingles: np.ndarray, slab: int = 1 << 14) -> bytes:
    """A fingerprint of 512 bits over the distinct hashes of word shingles, for similarities well below one."""
    counts = np.zeros((WIDE, BITS), np.int64)
    words = np.arange(WIDE, dtype=np.uint64)[:, None]
    for i in range(0, len(shingles), slab):
        h = mix(shingles[None, i : i + slab] + words)
        cuts = np.arange(0, h.shape[1], 255)  # a byte counts so many
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LOW_BITS, cuts, axis=1)  # one bit of each byte, eight side by side
            counts[:, bit::8] += lanes.view(np.uint8).reshape(WIDE, -1, 8).sum(1, dtype=np.int64)
    return np.packbits(counts.ravel() * 2 > len(shingles), bitorder="little").tobytes()


def most_differing(similarity: float, deviations: float = 0) -> int:
    """Differing bits of a wide fingerprint to be expected at a Jaccard similarity of the shingle sets, and so
    many standard deviations more."""
    n = BITS * WIDE
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return round(p * n + deviations * np.sqrt(p * (1 - p) * n))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by a Jaccard similarity of ``similarity`` or more of their
    shingle sets.

    Documents with equal sets meet as one. Fingerprints only give candidates: keys are sets of bits, as many as
    find a pair four standard deviations beyond the expected distance with probability 0.995 (a pair at
    the expected distance: over 0.9999), and a further margin is left for very short texts, whose bits differ more. Fingerprints
    with a shared key within that margin make coarse groups; inside a group all pairs are verified by their
    whole sets, in tiles of bounded size.
    """
    from gatherline.llm.minhash import shingles

    def prints_of(batches):
        for rows in blocks(batches, 1 << 20):
            sets = [np.unique(x) for x in shingles([r[0] for r in rows], words)]
            cells = [pa.array([r[1] for r in rows], pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([wide_fingerprint(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["key", "whole", "fp"])

    source = docs.where("doc_id is not null").select(F.col("text").cast("string").alias("t"), F.col("doc_id").cast("long").alias("k"))
    prints, _ = stored(source.mapInArrow(lean(prints_of), "key long, whole binary, fp binary"))
    each, _ = stored(prints.groupBy("whole").agg(F.min("key").alias("low"), F.first("fp").alias("fp")))
    most = most_differing(similarity, 7)
    bits = int(min(24, max(8, np.log2(max(1, each.count()) / 1024))))
    agree = (1 - most_differing(similarity, 4) / (BITS * WIDE)) ** bits
    tables = int(np.ceil(np.log(0.005) / np.log(1 - agree)))
    picked = np.array([np.random.default_rng(i).choice(BITS * WIDE, bits, replace=False) for i in range(tables)])

    def keys_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                raw = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
                on = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                k = np.stack([(on[:, p] << np.arange(bits)).sum(1) + (np.int64(i) << 40) for i, p in enumerate(picked)], 1)
                rows = np.repeat(np.arange(len(raw)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), part.column(1).take(pa.array(rows)), part.column(0).take(pa.array(rows))], ["k", "low", "fp"])

    def compare(batches):
        for t in runs(batches):
            a, b = wide_links(t.column(0).to_numpy(), t.column(1).to_numpy(), _words(t.column(2)), most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def sets_of(batches):
        for rows in blocks(batches, 1 << 20):
            sets = [np.unique(x) for x in shingles([r[0] for r in rows], words)]
            cells = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]
            raw = [pa.array(c, pa.binary()) for c in ([_digest(x) for x in sets], [wide_fingerprint(x) for x in sets], [x.tobytes() for x in sets])]
            yield pa.RecordBatch.from_arrays([*cells, *raw], ["k", "low", "whole", "fp", "set"])

    def verify(batches):
        for t in runs(batches):
            a, b = set_links(t.column(0).to_numpy(), t.column(1).to_numpy(), _words(t.column(2)), t.column(3), most, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = each.select("fp", "low").mapInArrow(lean(keys_of), "k long, low long, fp binary")
    coarse, _ = stored(components(tiled(dealt, "low", tile).mapInArrow(lean(compare), "a long, b long")))
    heads = source.join(coarse, F.col("k") == F.col("node")).select("t", F.col("root").alias("k"), F.col("node").alias("low"))
    sets, _ = stored(heads.mapInArrow(lean(sets_of), "k long, low long, whole binary, fp binary, set binary").dropDuplicates(["low", "whole"]).drop("whole"))
    root = components(tiled(sets, "low", set_tile).mapInArrow(lean(verify), "a long, b long"))
    return prints.select("key", "whole").join(each.select("whole", "low"), "whole").join(root, F.col("low") == F.col("node"), "left").select(F.col("key").alias("doc_id"), F.coalesce("root", "low").alias("component_id"))


def _digest(x: np.ndarray) -> bytes:
    return hashlib.md5(x.tobytes()).digest()


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def _ranges(keys: np.ndarray):
    """(start, end) of each run of two or more equal keys."""
    cuts = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys))
    several = np.flatnonzero(np.diff(cuts) > 1)
    return zip(cuts[several].tolist(), cuts[several + 1].tolist(), strict=True)


def _sieved(f: np.ndarray, g: np.ndarray, most: int, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places in f and g (a row for each word) of all pairs that may differ in at most ``most`` bits, by the first words.

    Unlike texts differ in half of their bits, so the words must have well over twice ``most`` bits to rule them
    out. A count that wraps lets a pair through, never out."""
    near = np.zeros((f.shape[1], g.shape[1]), np.uint8)
    x, n = np.empty(near.shape, np.uint64), np.empty(near.shape, np.uint8)
    for w in range(words):
        np.bitwise_xor(f[w, :, None], g[w, None, :], out=x)
        near += np.bitwise_count(x, out=n)
    return np.nonzero(near <= most)


def _close(f: np.ndarray, g: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in f and g (a row for each word) of all pairs with at most ``most`` differing bits."""
    i, j = _sieved(f, g, most)
    d = np.bitwise_count(f[:, i] ^ g[:, j]).sum(0, dtype=np.uint16)
    return i[d <= most], j[d <= most]


def wide_links(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, most: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _ranges(keys):
        f, d = np.ascontiguousarray(fps[lo:hi].T), ids[lo:hi]
        up = np.arange(hi - lo)  # each place's tree, named by its least place
        for at in range(0, hi - lo, rows):
            i, j = _close(f[:, at : at + rows], f[:, at:], most)
            a, b = up[i + at], up[j + at]
            apart = a != b
            if apart.any():
                for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
                    while up[x] != x:
                        x = up[x]
                    while up[y] != y:
                        y = up[y]
                    up[max(x, y)] = min(x, y)
                while (up[up] != up).any():
                    up = up[up]
        joined = np.flatnonzero(up != np.arange(hi - lo))
        left.append(d[up[joined]])
        right.append(d[joined])
    return np.concatenate(left), np.concatenate(right)


def set_links(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, sets, most: int, similarity: float) -> tuple[list, list]:
    """A spanning forest of the pairs within each run of equal keys whose whole sets are that similar."""
    left, right = [], []
    for lo, hi in _ranges(keys):
        s = [np.frombuffer(v, np.uint64) for v in sets.slice(lo, hi - lo).to_pylist()]
        n, f = np.array([len(x) for x in s]), fps[lo:hi]
        rest = np.arange(hi - lo)
        while len(rest):
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                i = front.pop()
                may = rest[(np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i])) & (np.bitwise_count(f[rest] ^ f[i]).sum(1) <= most)]
                near = [j for j in may.tolist() if _alike(s[i], s[j], similarity)]
                left += [int(ids[lo + i])] * len(near)
                right += ids[lo + np.array(near, np.int64)].tolist()
                front += near
                rest = rest[~np.isin(rest, near)]
    return left, right


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; all columns stay.

    Rows that share a doc_id stand or fall together; rows without one stay. Blank texts are copies of each other.
    """
    found = similar_classes(docs.select("doc_id", "text"), words, similarity)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
