"""Embedding near-duplicates: tiles compared along principal axes, leading ones first, until a pair cannot reach the threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.components import components
from gatherline.session import stored

#: Vectors of one side of a tile.
TILE = 2_048
#: Axes after which the bound is tested.
STOPS = (8, 24)
_SLACK = 1e-9


def usable() -> Column:
    """Rows that can link: an id, a label, and a vector with a length, finite numbers only and not all zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths, in double precision, of a list column whose lists are equally long."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / norm, x


def axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension, the principal axes of the unit vectors (columns, strongest first) and the direction they
    spread most along. Sums of products are added up by tasks; their number is the dimension squared."""

    def sums(batches):
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for d in np.unique(dims):
                u, _ = _matrix(batch.column(1).filter(pa.array(dims == d)))
                flat = np.concatenate((u.T @ u, u.sum(0)[None], np.full((1, d), float(len(u))))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat))), pa.array(flat)], ["dim", "k", "v"])

    total = vectors.select("dim", "embedding").mapInArrow(sums, "dim int, k long, v double").groupBy("dim", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in total.groupby("dim"):
        m = part.sort_values("k")["v"].to_numpy().reshape(d + 2, d)
        second, mean = m[:d] / m[d + 1, 0], m[d] / m[d + 1, 0]
        out[int(d)] = (np.linalg.eigh(second)[1][:, ::-1].copy(), np.linalg.eigh(second - np.outer(mean, mean))[1][:, -1].copy())
    return out


def near(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``threshold`` or more."""
    (ux, _), (uy, _) = x, y
    rx, ry = ux @ rotation, uy @ rotation
    rest = lambda r, k: np.sqrt((r[:, k:] ** 2).sum(1))
    hit = np.zeros((len(rx), len(ry)), bool)
    first = min(STOPS[0], rx.shape[1])
    for at in range(0, len(rx), 512):
        a = rx[at : at + 512]
        part = a[:, :first] @ ry[:, :first].T
        i, j = np.nonzero(part + np.outer(rest(a, first), rest(ry, first)) >= threshold - _SLACK)
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            got, done = part[p, q], first
            for stop in (*STOPS[1:], rx.shape[1]):
                if stop <= done:
                    continue
                got = got + (a[p, done:stop] * ry[q, done:stop]).sum(1)
                keep = got + rest(a, stop)[p] * rest(ry, stop)[q] >= threshold - _SLACK
                p, q, got, done = p[keep], q[keep], got[keep], stop
            exact = (ux[at + p] * uy[q]).sum(1) >= threshold
            hit[at + p[exact], q[exact]] = True
    return hit


def _forest(hit: np.ndarray) -> np.ndarray:
    """A parent for each node of a symmetric link matrix, so that the links to parents span its components."""
    n = len(hit)
    parent = np.arange(n)
    rest = np.flatnonzero(hit.any(1))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block = hit[np.ix_(front[:256], rest)]
            new = block.any(0)
            parent[rest[new]] = front[:256][block.argmax(0)[new]]
            front = np.concatenate((front[256:], rest[new]))
            rest = rest[~new]
    return parent


def linked(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, from links of cosine ``threshold`` or more within a label.

    Equal vectors of a label count as one with a weight. Vectors are laid in slabs along the direction of
    greatest spread, as wide as two linked vectors can be apart, so only neighbouring slabs meet; slabs are
    cut into tiles of bounded size, and a task compares two tiles. A tile gives each row's number of links and
    a spanning forest, not its pairs. Rows that are not usable, and vectors of unlike lengths, do not link; a
    null vec_id has a null component and is not kept. Rows that share a vec_id and vector are copies.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    each, _ = stored(rows.where(usable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")))
    turn = each.sparkSession.sparkContext.broadcast(axes(each))
    width = float(np.sqrt(2 - 2 * threshold)) + _SLACK

    def place(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            slab = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                u, _ = _matrix(batch.column("embedding").filter(pa.array(dims == d)))
                slab[dims == d] = np.floor(u @ turn.value[int(d)][1] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, "slab"])

    placed, _ = stored(each.mapInArrow(place, "label long, embedding array<float>, low long, n long, dim int, slab long"))
    where = ["label", "dim", "slab"]
    tiles = placed.groupBy(*where).agg(F.ceil(F.count("*") / tile).cast("long").alias("own"))
    beside = lambda step, name: tiles.select("label", "dim", (F.col("slab") - step).alias("slab"), F.col("own").alias(name))
    sizes, _ = stored(tiles.join(beside(1, "ahead"), where, "left").join(beside(-1, "behind"), where, "left").na.fill(0, ["ahead", "behind"]))
    mine = F.pmod(F.xxhash64("low"), F.col("own"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda s, across, a, b, side: F.struct(s.alias("s"), F.lit(across).alias("across"), a.alias("a"), b.alias("b"), side.alias("side"))
    t = F.col("mine")
    meets = F.concat(
        F.transform(upto("own"), lambda o: cell(F.col("slab"), False, F.least(t, o), F.greatest(t, o), (t > o).cast("int"))),
        F.transform(upto("ahead"), lambda o: cell(F.col("slab"), True, t, o, F.lit(0))),
        F.transform(upto("behind"), lambda o: cell(F.col("slab") - 1, True, o, t, F.lit(1))),
    )
    dealt = placed.join(sizes, where).withColumn("mine", mine).select("label", "dim", "low", "n", "embedding", F.explode(meets).alias("m")).select("label", "dim", "low", "n", "embedding", "m.*")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, across, a, b = key[1].as_py(), key[3].as_py(), key[4].as_py(), key[5].as_py()
        table = table.combine_chunks()
        side, low, n = (np.asarray(table.column(c)) for c in ("side", "low", "n"))
        x = _matrix(table.column("embedding").combine_chunks())
        rotation = turn.value[dim][0]
        if across or a != b:
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = np.zeros((len(low), len(low)), bool)
            hit[np.ix_(one, two)] = near(tuple(v[one] for v in x), tuple(v[two] for v in x), rotation, threshold)
            hit |= hit.T
        else:
            hit = near(x, x, rotation, threshold)
            np.fill_diagonal(hit, False)
        some = np.flatnonzero(hit.any(1))
        return pa.table({"a": low[some], "b": low[_forest(hit)[some]], "links": hit[some].astype(np.float32) @ n.astype(np.float64) if len(some) else np.zeros(0)})

    found, _ = stored(dealt.groupBy("label", "dim", "s", "across", "a", "b").applyInArrow(compare, "a long, b long, links double"))
    degree = found.groupBy("a").agg(F.sum("links").cast("long").alias("links"))
    root = components(found.where("a != b").select("a", "b"))
    class_, _ = stored(
        each.join(degree, F.col("low") == F.col("a"), "left")
        .join(root, F.col("low") == F.col("node"), "left")
        .select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "low").alias("component_id"))
    )
    usable_rows = rows.withColumn("u", usable()).withColumn("ul", F.when(F.col("u"), F.col("label"))).withColumn("ue", F.when(F.col("u"), F.col("embedding")))
    out = usable_rows.join(class_.withColumnsRenamed({"label": "ul", "embedding": "ue"}), ["ul", "ue"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
