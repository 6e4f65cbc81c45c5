"""Summaries of sampled signals, group pooling and synchrony between members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.functions.exprs import col
from gatherline.operators.ordered import agg_with_percentiles, exact_percentiles, join_on, ordered_scan, parts_of, prev, row_no, settle


def slope_ref(t, y) -> Column:
    """sum(x0 (y - mean y)) / sum(x0^2) with x0 = t - min t; x0 is not centred below the line.

    Written with covariance and variance, which stay accurate for epoch times.
    """
    t, y = col(t), col(y)
    tt = F.when(y.isNotNull(), t)
    yy = F.when(t.isNotNull(), y)
    down = F.var_pop(tt) + (F.avg(tt) - F.min(tt)) * (F.avg(tt) - F.min(tt))
    return F.when((F.count(F.when(tt.isNotNull(), yy)) >= 2) & (down > 0), F.covar_pop(tt, yy) / down)


def slope_ols(t, y) -> Column:
    return F.regr_slope(col(y), col(t))


def signal_summary(df: DataFrame, keys: Sequence[str], t: str, x: str, prefix: str = "") -> DataFrame:
    """Coverage %, mean, median, population sd, min, p95, max and slope of one channel."""
    p = prefix
    aggs = [
        (F.count(x) / F.count(F.lit(1)) * 100.0).alias(f"{p}coverage_pct"), F.avg(x).alias(f"{p}mean"),
        F.stddev_pop(x).alias(f"{p}std"), F.min(x).alias(f"{p}min"), F.max(x).alias(f"{p}max"), slope_ref(t, x).alias(f"{p}slope"),
    ]
    return agg_with_percentiles(df, keys, aggs, {f"{p}median": (x, 0.5), f"{p}p95": (x, 0.95)})


def vector_features(df: DataFrame, keys: Sequence[str], order: Sequence, axes: Sequence[str], fs: float = 1.0, high: float | None = None) -> DataFrame:
    """Magnitude features of a vector signal; a missing axis counts as 0 in the magnitude.

    The keys go in one struct, which is never null, and the rows are dealt by it once, to as many tasks as they
    fill: the scan, both passes of the percentiles and their joins find them there.
    """
    mag = F.sqrt(sum((F.coalesce(F.col(a) * F.col(a), F.lit(0.0)) for a in axes), F.lit(0.0)))
    full = F.lit(True)
    for a in axes:
        full = full & F.col(a).isNotNull()
    at = [f"_at{i}" for i in range(len(order))]
    d = df.select(F.struct(*keys).alias("_key"), mag.alias("_mag"), full.cast("double").alias("_full"), *[col(o).alias(a) for o, a in zip(order, at, strict=True)])
    d = ordered_scan(d, ["_key"], at, {"_pm": prev("_mag")}, parts=parts_of(df))
    d = join_on(d, exact_percentiles(d, ["_key"], {"_med": ("_mag", 0.5)}), ["_key"], "left")
    d = d.withColumns({"_dyn": F.abs(F.col("_mag") - F.col("_med")), "_jerk": F.abs(F.col("_mag") - F.col("_pm")) * F.lit(float(fs))})
    aggs = [
        (F.avg("_full") * 100.0).alias("coverage_pct"), F.avg("_mag").alias("motion_mean"), F.stddev_pop("_mag").alias("motion_std"),
        F.max("_mag").alias("motion_max"), F.avg("_dyn").alias("dynamic_mean"), F.avg("_jerk").alias("jerk_mean"),
    ]
    if high is not None:
        aggs.append(F.avg((F.col("_mag") > high).cast("double")).alias("high_fraction"))
    spec = {"motion_p95": ("_mag", 0.95), "dynamic_p95": ("_dyn", 0.95), "jerk_p95": ("_jerk", 0.95)}
    out = agg_with_percentiles(d, ["_key"], aggs, spec)
    return out.select("_key.*", *[c for c in out.columns if c != "_key"])


def sample_rate(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """1 / median positive time step; null under five samples."""
    d = ordered_scan(df.filter(F.col(t).isNotNull()), keys, [t], {"_p": prev(t)})
    d = d.withColumn("_dt", F.when(F.col(t) > F.col("_p"), F.col(t) - F.col("_p")))
    a = agg_with_percentiles(d, keys, [F.count(F.lit(1)).alias("n")], {"_m": ("_dt", 0.5)})
    return a.select(*keys, "n", F.when((F.col("n") >= 5) & (F.col("_m") > 0), 1.0 / F.col("_m")).alias("rate_hz"))


def pool_members(df: DataFrame, keys: Sequence[str], cols: Sequence[str], member: str, digits: int = 4, population: bool = False) -> DataFrame:
    """Group windows from member windows: members, valid counts, mean and sd of each column."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = [F.count_distinct(member).alias("n_members")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(sd(c), digits).alias(f"{c}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def dyads(members: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Unordered pairs of the distinct members of a group (a before b); a pair table, never row pairs."""
    m = members.select(*keys, member).distinct()
    b = m.withColumnRenamed(member, "b")
    return m.withColumnRenamed(member, "a").join(b, list(keys)).filter(F.col("a") < F.col("b"))


def dyad_synchrony(df: DataFrame, keys: Sequence[str], member: str, index: str, x: str, max_lag: int = 2, min_n: int = 3) -> DataFrame:
    """Correlation of each pair's window series, at lag 0 and at the best lag by position.

    Input has one row per (keys, member, window). Positions count the windows where
    either member has a row. The best lag has the largest signed correlation, the
    first one on ties; all-null series give a null lag.
    """
    base = settle(df.select(*keys, F.col(member).alias("_m"), F.col(index).alias("_w"), F.col(x).alias("_x")))
    side = lambda m, k: F.struct(F.col(m).alias("_m"), F.lit(k).alias("side"))
    pr = dyads(base, keys, "_m").withColumn("_s", F.explode(F.array(side("a", 0), side("b", 1)))).select(*keys, "a", "b", "_s.*")
    pk = [*keys, "a", "b"]
    both = settle(pr.join(base, [*keys, "_m"]).groupBy(*pk, "_w").agg(
        F.max(F.when(F.col("side") == 0, F.col("_x"))).alias("_xa"), F.max(F.when(F.col("side") == 1, F.col("_x"))).alias("_xb")))
    pos = ordered_scan(both, pk, ["_w"], {"_p": row_no()})
    # x at position j meets y at position j - lag: each y goes to the positions of its partners, one column a lag
    lags = range(-max_lag, max_lag + 1)
    none = F.lit(None).cast(both.schema["_xa"].dataType)
    meet = lambda at, xa, xb, lag: F.struct(at.alias("at"), xa.alias("xa"), xb.alias("xb"), F.lit(lag).cast("int").alias("lag"))
    sent = F.array(meet(F.col("_p"), F.col("_xa"), none, None), *[meet(F.col("_p") + lag, none, F.col("_xb"), lag) for lag in lags])
    met = pos.select(*pk, F.explode(sent).alias("_e")).groupBy(*pk, F.col("_e.at").alias("_at")).agg(
        F.max("_e.xa").alias("_xa"), F.bool_or(F.col("_e.lag").isNull()).alias("_own"), *[F.max(F.when(F.col("_e.lag") == lag, F.col("_e.xb"))).alias(f"_y{i}") for i, lag in enumerate(lags)])
    c = met.groupBy(*pk).agg(F.count_if("_own").alias("window_count"), *[corr_or_null("_xa", f"_y{i}", min_n).alias(f"_c{i}") for i in range(len(lags))])
    ranked = F.array(*[F.struct(F.col(f"_c{i}").alias("c"), F.lit(-lag).alias("l")) for i, lag in enumerate(lags)])
    best = F.array_max(F.filter(ranked, lambda r: r["c"].isNotNull()))
    return c.withColumn("_b", best).select(*pk, F.col(f"_c{max_lag}").alias("corr"), F.col("_b.c").alias("best_corr"), (-F.col("_b.l")).alias("best_lag"), "window_count")


def corr_or_null(a, b, min_n: int = 3) -> Column:
    """Pearson over complete rows; null below ``min_n`` rows or without spread."""
    a, b = col(a), col(b)
    ok = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(ok, a), F.when(ok, b)
    return F.when((F.count(aa) >= min_n) & (F.stddev_pop(aa) > 0) & (F.stddev_pop(bb) > 0), F.corr(aa, bb))


def cross_correlation(df: DataFrame, keys: Sequence[str], bin_col: str, a: str, b: str, max_lag: int) -> DataFrame:
    """Best shift of b against a by normalised product sums over bins; ties go to the smallest shift."""
    xs = df.select(*keys, F.col(bin_col).alias("_at"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"),
                   F.col(a).alias("_a"), F.lit(None).cast("double").alias("_b"))
    ys = df.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).select(
        *keys, (F.col(bin_col) + F.col("lag")).alias("_at"), "lag", F.lit(None).cast("double").alias("_a"), F.col(b).alias("_b"))
    met = xs.unionByName(ys).groupBy(*keys, "lag", "_at").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    met = met.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    s = met.groupBy(*keys, "lag").agg(
        F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"),
        F.sqrt(F.avg((F.col("_a") - F.col("_b")) ** 2)).alias("rmse"))
    s = s.withColumn("score", F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))))
    rank = F.when(F.col("score").isNotNull(), F.struct(F.round("score", 9), -F.abs("lag"), -F.col("lag")))
    return s.groupBy(*keys).agg(F.max_by("lag", rank).alias("best_lag"), F.max("score").alias("best_score"), F.min("rmse").alias("best_rmse"))
