"""Deterministic sampling and resampling: hashes of keys and seeds, never row order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.operators.ordered import exact_percentiles

#: Replicate weights are drawn by arithmetic modulo this prime (2**31 - 1).
PRIME = 2_147_483_647


def stratified_sample(df: DataFrame, label: str, quotas: Mapping[str, int], order: Sequence) -> DataFrame:
    """The first ``quota`` rows of each label by a hash order; same rows on any partitioning.

    The rank filter is applied per task before the shuffle, so a label holding a third
    of the rows still sends only its quota.
    """
    quota = F.coalesce(*[F.when(F.col(label) == k, F.lit(int(v))) for k, v in quotas.items()])
    rn = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    top = max(quotas.values())
    return df.filter(F.col(label).isin(*quotas)).withColumn("_rn", rn).filter(F.col("_rn") <= top).filter(F.col("_rn") <= quota).drop("_rn")


def blind_and_key(sample: DataFrame, visible: Sequence[str], hidden: Sequence[str], seed: int, id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A blind table in shuffled order and the answer key, linked by ``sample_id``."""
    s = sample.withColumn("sample_id", F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]), 224))
    return s.select("sample_id", *visible), s.select("sample_id", *hidden)


def poisson_steps() -> list[int]:
    """Where a uniform whole number below PRIME passes to the next Poisson(1) count; nothing beyond can be told apart."""
    p = total = math.exp(-1)
    out = [math.ceil(total * PRIME)]
    while out[-1] < PRIME - 1 and len(out) < 20:
        p /= len(out)
        total += p
        out.append(math.ceil(total * PRIME))
    return [t for t in out if t < PRIME]


def _scramble(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below PRIME (fifth powers)."""
    sq = x * x % PRIME
    return sq * sq % PRIME * x % PRIME


def poisson_weights(ids: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(ids, replicates): Poisson(1) counts from whole-number arithmetic on (seed, id, replicate)."""
    y = _scramble((ids % PRIME * 48271 + seed * 69621 + 11) % PRIME)
    u = _scramble((_scramble((y[:, None] + np.arange(1, n_boot + 1) * 40692) % PRIME) + 12345) % PRIME)
    return np.searchsorted(np.array(poisson_steps()), u, side="right").astype(np.float64)


def replicate_sums(df: DataFrame, keys: Sequence[str], id_col: str, values: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, _b, _w, _s0, ...): per key and replicate the sum of weights and of weight times each value.

    A task adds up its rows' weights as arrays, one per key and batch; only these sums are shuffled. Ids that
    are not whole numbers are hashed.
    """
    whole = df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    ident = F.col(id_col).cast("long") if whole else F.xxhash64(id_col)
    kn, vn = [f"_k{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(values))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, kn, strict=True)], F.coalesce(ident, F.lit(0).cast("long")).alias("_id"),
                  *[F.col(v).cast("double").alias(n) for v, n in zip(values, vn, strict=True)])
    sums = ["_w", *[f"_s{i}" for i in range(len(values))]]
    rows = max(1, 2_000_000 // n_boot)

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, rows):
                b = whole_batch.slice(at, rows)
                code = b.select(kn).to_pandas().groupby(kn, dropna=False, sort=False).ngroup().to_numpy() if kn else np.zeros(b.num_rows, np.int64)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                w = poisson_weights(b.column("_id").to_numpy()[order], n_boot, seed)
                cells = [np.add.reduceat(w, starts)] + [np.add.reduceat(w * b.column(v).to_numpy(zero_copy_only=False)[order][:, None], starts) for v in vn]
                keyed = b.select(kn).take(pa.array(order[starts])).columns if kn else []
                ends = np.arange(0, n_boot * (len(starts) + 1), n_boot, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.ravel())) for c in cells]
                yield pa.RecordBatch.from_arrays([*keyed, *lists], [*kn, *sums])

    schema = T.StructType([*[T.StructField(n, df.schema[k].dataType) for k, n in zip(keys, kn, strict=True)], *[T.StructField(s, T.ArrayType(T.DoubleType())) for s in sums]])
    parts = d.mapInArrow(run, schema).select(*kn, F.posexplode(F.arrays_zip(*sums)).alias("_b", "_c"))
    total = parts.groupBy(*kn, "_b").agg(*[F.sum(f"_c.{s}").alias(s) for s in sums])
    return total.withColumnsRenamed(dict(zip(kn, keys, strict=True)))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, id_col: str, n_boot: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Mean with a percentile interval from Poisson bootstrap; replicates are summed inside the tasks."""
    r = replicate_sums(df.filter(F.col(value).isNotNull()), keys, id_col, [value], n_boot, seed).filter("_w > 0")
    tail = (1 - level) / 2
    q = exact_percentiles(r.select(*keys, (F.col("_s0") / F.col("_w")).alias("_m")), keys, {"ci_low": ("_m", tail), "ci_high": ("_m", 1 - tail)})
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return m.join(q, list(keys))
