"""Group and whole-table statistics attached back to rows.

Statistics are aggregated first (partial aggregation on the map side), then joined
back on the key, so a hot key is a skewed join that adaptive execution can split
rather than one oversized window partition. Without keys the one-row aggregate is
a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.functions.exprs import col
from gatherline.operators.ordered import (
    agg_with_percentiles, exact_percentiles, join_on, settle, value_ranks,
)


def with_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add aggregate columns computed per ``keys`` over ``source`` (default: the rows themselves)."""
    src = df if source is None else source
    if not keys or list(keys) == ["_all"]:
        one = src.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("s"))
        out = df.withColumn("_s", one.scalar())
        return out.withColumns({k: F.col(f"_s.{k}") for k in aggs}).drop("_s")
    return join_on(df, src.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()]), keys, "left")


def z_within(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_z", population: bool = False,
             zero_neutral: bool = True) -> DataFrame:
    """(x - mean) / sd inside each group; with no spread a present value scores 0."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_d_{c}"] = sd(c)
    out = with_stats(df, keys, aggs)
    new = {}
    for c in cols:
        flat = F.lit(0.0) if zero_neutral else F.lit(None).cast("double")
        z = F.when(F.col(f"_d_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}"))
        new[c + suffix] = z.otherwise(F.when(F.col(c).isNotNull(), flat))
    return out.withColumns(new).drop(*aggs)


def baseline_z(df: DataFrame, person: Sequence[str], task: str, cols: Sequence[str], baseline: str = "T0", suffix: str = "_bz") -> DataFrame:
    """Distance from the person's baseline task in the person's own sd; plain z where no baseline."""
    aggs = {}
    for c in cols:
        aggs[f"_b_{c}"] = F.max(F.when(F.col(task) == baseline, F.col(c)))
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_d_{c}"] = F.stddev_samp(c)
    out = with_stats(df, person, aggs)
    new = {}
    for c in cols:
        centre = F.coalesce(F.col(f"_b_{c}"), F.col(f"_m_{c}"))
        z = F.when(F.col(f"_d_{c}") > 0, (F.col(c) - centre) / F.col(f"_d_{c}"))
        new[c + suffix] = z.otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))
    return out.withColumns(new).drop(*aggs)


def baseline_delta(df: DataFrame, person: Sequence[str], task: str, cols: Sequence[str], baseline: str = "T0",
                   preferred: DataFrame | None = None, active: Sequence[str] = ("T1", "T2", "T3", "T4")) -> DataFrame:
    """``c_delta`` and ``c_dz`` against a baseline.

    The baseline is the person's value in ``preferred`` (the quiet part of the first
    task), else the whole first task, else the person's own mean over active tasks.
    The z form uses the sd over active tasks and needs sd > 1e-9.
    """
    aggs = {}
    for c in cols:
        aggs[f"_b_{c}"] = F.max(F.when(F.col(task) == baseline, F.col(c)))
        aggs[f"_m_{c}"] = F.avg(F.when(F.col(task).isin(*active), F.col(c)))
        aggs[f"_d_{c}"] = F.stddev_samp(F.when(F.col(task).isin(*active), F.col(c)))
    out = with_stats(df, person, aggs)
    if preferred is not None:
        p = preferred.select(*person, *[F.col(c).alias(f"_f_{c}") for c in cols])
        out = join_on(out, p, person, "left")
    new = {}
    for c in cols:
        chain = ([F.col(f"_f_{c}")] if preferred is not None else []) + [F.col(f"_b_{c}"), F.col(f"_m_{c}")]
        base = F.coalesce(*chain)
        new[f"{c}_delta"] = F.col(c) - base
        new[f"{c}_dz"] = F.when(F.col(f"_d_{c}") > 1e-9, (F.col(c) - base) / F.col(f"_d_{c}"))
    return out.withColumns(new).drop(*aggs, *[f"_f_{c}" for c in cols])


def robust_z(df: DataFrame, keys: Sequence[str], c: str, out: str, stats_from: Column | None = None, keep_raw: bool = False) -> DataFrame:
    """(x - median) / (1.4826 MAD) per key; centred only when the MAD is ~0; null under two rows.

    ``stats_from`` restricts the rows the statistics come from (all rows are still
    scored). ``keep_raw`` leaves keys without statistics unscaled.
    """
    src = (df if stats_from is None else df.filter(stats_from)).select(*keys, F.col(c).cast("double").alias("_x"))
    med = settle(agg_with_percentiles(src, keys, [F.count("_x").alias("_nx")], {"_med": ("_x", 0.5)}))
    dev = join_on(src, med, keys, "inner").withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    stats = settle(join_on(med, exact_percentiles(dev, keys, {"_mad": ("_dev", 0.5)}), keys, "left"))
    j = join_on(df, stats, keys, "left")
    scale = F.lit(1.4826) * F.col("_mad")
    z = F.when(F.col("_mad") < 1e-9, F.col(c) - F.col("_med")).otherwise((F.col(c) - F.col("_med")) / scale)
    z = F.when(F.col("_nx") >= 2, z)
    if keep_raw:
        z = F.when(F.col("_nx").isNull() | (F.col("_nx") < 2), F.col(c).cast("double")).otherwise(z)
    return j.withColumn(out, z).drop("_med", "_nx", "_mad")


def winsorise(df: DataFrame, cols: Sequence[str], n_sd: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Clip at mean +/- n_sd sample sd; columns with under 4 values stay as they are."""
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_d_{c}"] = F.stddev_samp(c)
        aggs[f"_n_{c}"] = F.count(c)
    out = with_stats(df, keys, aggs)
    new = {}
    for c in cols:
        x, m, d = F.col(c), F.col(f"_m_{c}"), F.col(f"_d_{c}")
        clipped = F.least(F.greatest(x, m - n_sd * d), m + n_sd * d)
        new[c] = F.when(x.isNotNull() & (F.col(f"_n_{c}") >= 4) & (d > 0), clipped).otherwise(x)
    return out.withColumns(new).drop(*aggs)


def min_max(df: DataFrame, c: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    d = with_stats(df, keys, {"_lo": F.min(c), "_hi": F.max(c)})
    span = F.col("_hi") - F.col("_lo")
    return d.withColumn(out, F.when(span > 0, (F.col(c) - F.col("_lo")) / span).when(F.col(c).isNotNull(), 0.0)).drop("_lo", "_hi")


def focal_vs_others(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Own value, mean and population sd of the other members of the group."""
    x = F.col(c)
    d = with_stats(df, keys, {"_n": F.count(c), "_s": F.sum(c), "_q": F.sum(x * x)})
    own = F.when(x.isNotNull(), 1).otherwise(0)
    n = F.col("_n") - own
    s = F.coalesce(F.col("_s"), F.lit(0.0)) - F.coalesce(x, F.lit(0.0))
    q = F.coalesce(F.col("_q"), F.lit(0.0)) - F.coalesce(x * x, F.lit(0.0))
    mean = F.when(n > 0, s / n)
    var = F.when(n > 0, F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    return d.withColumns({"others_n": n, "others_mean": mean, "others_sd": F.sqrt(var)}).drop("_n", "_s", "_q")


def versus_group(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Delta from the group mean and z by the group's population sd (null without spread)."""
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_d_{c}"] = F.stddev_pop(c)
    out = with_stats(df, keys, aggs)
    new = {}
    for c in cols:
        delta = F.col(c) - F.col(f"_m_{c}")
        new[f"{c}_vs_group"] = delta
        new[f"{c}_group_z"] = F.when(F.col(f"_d_{c}") > 0, delta / F.col(f"_d_{c}"))
    return out.withColumns(new).drop(*aggs)


def share_and_rank(df: DataFrame, keys: Sequence[str], c: str, share: str = "share", rank: str = "rank_desc") -> DataFrame:
    """Share of the group's total and rank by descending value (ties share the best rank)."""
    d = with_stats(df, keys, {"_total": F.sum(c)})
    r = value_ranks(df.select(*keys, (-F.col(c)).alias("_neg")), keys, "_neg")
    r = r.select(*keys, "_neg", F.col("min_rank").alias(rank))
    d = join_on(d.withColumn("_neg", -F.col(c)), r, [*keys, "_neg"], "left")
    return d.withColumn(share, F.when(F.col("_total") != 0, F.col(c) / F.col("_total"))).drop("_total", "_neg")


def quantile_labels(df: DataFrame, keys: Sequence[str], c: str, out: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Low / Moderate / High by the group's quantiles; a constant group is Moderate."""
    q = exact_percentiles(df, keys, {"_ql": (c, low), "_qh": (c, high)})
    d = join_on(df, q, keys, "left")
    x = F.col(c)
    lab = (
        F.when(x.isNull(), "").when(F.col("_ql") == F.col("_qh"), "Moderate")
        .when(x <= F.col("_ql"), "Low").when(x >= F.col("_qh"), "High").otherwise("Moderate")
    )
    return d.withColumn(out, lab).drop("_ql", "_qh")


def median_split(df: DataFrame, c: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """high when >= the median, else low."""
    if keys:
        d = join_on(df, exact_percentiles(df, keys, {"_med": (c, 0.5)}), keys, "left")
    else:
        d = df.withColumn("_med", exact_percentiles(df.select(F.col(c).cast("double").alias("_x")), [], {"m": ("_x", 0.5)}).select("m").scalar())
    return d.withColumn(out, F.when(F.col(c) >= F.col("_med"), "high").when(F.col(c).isNotNull(), "low")).drop("_med")


def gini(df: DataFrame, keys: Sequence[str], c: str, out: str = "gini", on_empty: float | None = 0.0) -> DataFrame:
    """Gini coefficient per key; ``on_empty`` is the value when the total is 0 (0 or null)."""
    ranked = value_ranks(df, keys, c)
    # sum over members of (2 rank - n - 1) x, with tied members taken together
    num = F.sum((2 * F.col("avg_rank") - F.col("total") - 1) * F.col(c) * F.col("n"))
    tot = F.sum(F.col(c) * F.col("n"))
    n = F.max("total")
    return ranked.groupBy(*keys).agg(F.when(tot != 0, num / (n * tot)).otherwise(F.lit(on_empty).cast("double")).alias(out))


def entropy_of_shares(df: DataFrame, keys: Sequence[str], part: Sequence[str], weight: Column, out: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of the shares of ``part`` in each key; 0 when the total is 0.

    Uses H = log2(T) - sum(w log2 w) / T, so no join back to the total is needed.
    """
    w = df.groupBy(*keys, *part).agg(weight.cast("double").alias("_w"))
    t = F.sum("_w")
    plogp = F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.log2("_w")).otherwise(0.0))
    return w.groupBy(*keys).agg(F.when(t > 0, F.log2(t) - plogp / t).otherwise(0.0).alias(out))


def herfindahl(df: DataFrame, keys: Sequence[str], part: Sequence[str], weight: Column, out: str = "hhi") -> DataFrame:
    w = df.groupBy(*keys, *part).agg(weight.cast("double").alias("_w"))
    t = F.sum("_w")
    return w.groupBy(*keys).agg(F.when(t != 0, F.sum(F.col("_w") * F.col("_w")) / (t * t)).alias(out))


