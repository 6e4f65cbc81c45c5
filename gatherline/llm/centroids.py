"""Centroid clustering in whole numbers: a tournament of bisecting planes gives each vector its nearest centroid."""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Components below this fit products of 64 of them in 64 bits; vectors with larger ones are computed in Python's own integers.
_SMALL = 1 << 26
_SUM = pa.decimal128(38, 0)
_STEP = 4_096


def usable(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v (doubles) of the rows whose vector has ``dims`` components, none of them null or non-finite."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce((F.size("embedding") == dims) & fine, F.lit(False))).withColumnRenamed("embedding", "v")


def whole(column, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, one row per vector; an array of Python integers where one is large."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    if np.abs(x).max(initial=0) * scale < _SMALL:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()], object)


class Bisectors:
    """Normals and thresholds of the planes halfway between each two centroids: a positive side belongs to the second."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(v) < _SMALL for c in centroids for v in c)
        self.centroids = np.array(centroids, np.int64 if small else object)
        self.normals = 2 * (self.centroids[None] - self.centroids[:, None])
        squares = (self.centroids * self.centroids).sum(1)
        self.thresholds = squares[None] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's nearest centroid, the smallest of equally near ones.

        Each centroid in turn meets the winner so far; on the plane itself the winner, whose number is smaller, stays.
        """
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), _STEP):
            part = x[at : at + _STEP]
            best = np.zeros(len(part), np.int64)
            for j in range(1, len(self.centroids)):
                side = (part * self.normals[best, j]).sum(1) - self.thresholds[best, j]
                best[side > 0] = j
            out[at : at + _STEP] = best
        return out

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        d = x - self.centroids[cluster]
        return (d * d).sum(1)


def _assigned(batch, planes: Bisectors, scale: int) -> tuple[np.ndarray, np.ndarray]:
    x = whole(batch.column("v"), scale)
    return x, planes.nearest(x)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _SUM)


def _start(rows: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    hashed = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy("h", "v").limit(k).select("v").collect()  # k rows
    return whole(pa.array([r.v for r in first], pa.list_(pa.float64())), scale).tolist() if first else []


def _moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after a round: each the floor of its vectors' mean. Tasks add up, so k rows of sums arrive here."""

    def sums(batches):
        planes, total, n = Bisectors(centroids), {}, {}
        for batch in batches:
            x, cluster = _assigned(batch, planes, scale)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                total[c] = total.get(c, 0) + mine.sum(0).astype(object)
                n[c] = n.get(c, 0) + len(mine)
        if total:
            cells = [(c, n[c], i, v) for c in total for i, v in enumerate(total[c].tolist())]
            c, m, i, v = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(m, pa.int64()), pa.array(i, pa.int32()), _decimals(v)], ["c", "n", "i", "v"])

    got = rows.mapInArrow(sums, "c int, n long, i int, v decimal(38,0)").groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # k * dims rows
    out = [list(c) for c in centroids]
    for r in got:
        out[r.c][r.i] = int(r.v) // r.n
    return out


def _inertia(rows: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, int]:
    """The sum of distances of each cluster that has vectors."""

    def sums(batches):
        planes, total = Bisectors(centroids), {}
        for batch in batches:
            x, cluster = _assigned(batch, planes, scale)
            far = planes.distances(x, cluster)
            for c in np.unique(cluster).tolist():
                total[c] = total.get(c, 0) + int(far[cluster == c].astype(object).sum())
        if total:
            held = [min(v, 1 << 63) for v in total.values()]  # beyond a long as it is
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), _decimals(held)], ["c", "v"])

    return {r.c: int(r.v) for r in rows.mapInArrow(sums, "c int, v decimal(38,0)").groupBy("c").agg(F.sum("v").alias("v")).collect()}


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each usable vector.

    The first centroids are the vectors with the least sha256 of ``salt:vec_id``, at most ``k``; rows that share a
    vec_id go by their components. Each round assigns all vectors and moves every non-empty centroid to the floor of
    its vectors' mean; then they are assigned once more. Nothing is shuffled but sums, and only centroids
    (k * dims numbers) pass through the driver; every pass reads the table again, so a lost executor costs its tasks.

    Rows that are null, of another length, or hold null or non-finite components have no row here; repeated rows have
    one each. A null vec_id is assigned but never a first centroid; without any first centroid all columns but vec_id
    are null. Equally near centroids: the smaller number. Sums of squares beyond a long are null; components
    from 1e25 on can overflow the sums, which stops the query. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, dims)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = _start(rows, k, scale, salt)
    if not centroids:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", ")[1:])])
    for _ in range(rounds):
        centroids = _moved(rows, centroids, scale)
    spread = _inertia(rows, centroids, scale)
    fits = lambda v: v if v < 1 << 63 else None
    everything = fits(sum(spread.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def label(batches):
        planes = Bisectors(centroids)
        for batch in batches:
            x, cluster = _assigned(batch, planes, scale)
            near = cluster.tolist()
            far = planes.distances(x, cluster)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(cluster.astype(np.int32)),
                    pa.array([fits(int(d)) for d in far] if far.dtype == object else far, pa.int64()),
                    pa.array([fits(spread[c]) for c in near], pa.int64()),
                    pa.array([everything] * len(near), pa.int64()),
                    pa.array([digests[c] for c in near], pa.string()),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(label, schema)
