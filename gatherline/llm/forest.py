"""A random forest for small tables of features: trees are grown in Spark tasks, each over the same bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

TREES = 32
DEPTH = 8
_BINS = 32


def _grow(x: np.ndarray, y: np.ndarray, rng, depth: int = DEPTH, least: int = 2) -> list[tuple]:
    """Nodes (feature, threshold, left, right, share of ones) of one tree over a bootstrap sample; feature -1 marks a leaf."""
    rows = rng.integers(0, len(y), len(y))
    x, y = x[rows], y[rows]
    tried = max(1, round(np.sqrt(x.shape[1])))
    nodes: list[tuple] = []

    def split(part: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(y[part].mean())))
        if level == depth or len(part) < 2 * least or y[part].min() == y[part].max():
            return at
        best = None
        for f in rng.choice(x.shape[1], tried, replace=False):
            v = x[part, f]
            for cut in np.unique(np.quantile(v, np.arange(1, _BINS) / _BINS)):
                low = v <= cut
                n = int(low.sum())
                if least <= n <= len(part) - least:
                    a, b = y[part[low]].mean(), y[part[~low]].mean()
                    impurity = n * a * (1 - a) + (len(part) - n) * b * (1 - b)
                    if best is None or impurity < best[0]:
                        best = (impurity, int(f), float(cut), low)
        if best is not None:
            _, f, cut, low = best
            left = split(part[low], level + 1)
            right = split(part[~low], level + 1)
            nodes[at] = (f, cut, left, right, nodes[at][4])
        return at

    split(np.arange(len(y)), 0)
    return nodes


def grow(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list[np.ndarray]:
    """The trees of a forest on a sample that fits in memory; their size is bounded by the depth."""
    shared = spark.sparkContext.broadcast((x, y))

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                nodes = np.array(_grow(*shared.value, np.random.default_rng(i)))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([nodes.ravel().tolist()], pa.list_(pa.float64()))], ["tree", "nodes"])

    rows = spark.range(trees, numPartitions=min(trees, 8)).mapInArrow(run, "tree long, nodes array<double>").collect()
    return [np.array(r.nodes).reshape(-1, 5) for r in sorted(rows, key=lambda r: r.tree)]


def predict(trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The mean share of ones in the leaves that each row reaches."""
    out = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        f = t[:, 0].astype(np.int64)
        for _ in range(DEPTH):
            inner = f[at] >= 0
            low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at, 1]
            at = np.where(inner, np.where(low, t[at, 2], t[at, 3]).astype(np.int64), at)
        out += t[at, 4]
    return out / max(1, len(trees))
