"""Connected components of a graph of long ids, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.session import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest id reachable.

    Self links, repeated links and links with a null end are ignored. Each round sends every larger neighbour
    to the smallest one, then every smaller one to it; minima combine before the shuffle, and both sides of
    each join are read from tables, so that a hub's rows can be split. Rounds grow with the logarithm of the
    longest path. Tables go to the shared folder.
    """
    spark = edges.sparkSession
    now, path = stored(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, p1 = _stars(both, F.col("b") > F.col("a"))
        small, p2 = _stars(large, F.lit(True), own=True)
        drop_stored(spark, p1)
        drop_stored(spark, path)
        now, path = small, p2
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(pairs: DataFrame, where, own: bool = False) -> tuple[DataFrame, str]:
    """Link each neighbour that passes ``where`` to the least of its centre's neighbourhood."""
    spark = pairs.sparkSession
    least, path = stored(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")))
    moved = pairs.join(least, F.col("a") == F.col("c")).where(where & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if own:
        moved = moved.unionByName(least.where("c != m").select(F.col("c").alias("a"), F.col("m").alias("b")))
    out, at = stored(_distinct(moved.where("a != b")))
    drop_stored(spark, path)
    return out, at


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.distinct()


def _mark(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def runs(batches, key: int = 0):
    """Arrow batches, sorted by the column ``key``, as tables that hold each key's rows together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held
