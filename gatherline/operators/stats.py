"""Statistics and audits as aggregates. Ranks come from value counts, never from a global sort in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.functions.exprs import ratio
from gatherline.operators.groups import with_stats
from gatherline.operators.ordered import (
    agg_with_percentiles, cum_sum, exact_percentiles, join_on, key_sum, ordered_scan, prev, rev_min, row_no, settle, unpivot_values, value_ranks,
)
from gatherline.operators.signals import corr_or_null


def _const(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """Give a keyless call one constant key."""
    return (df, list(keys), False) if keys else (df.withColumn("_all", F.lit(0)), ["_all"], True)


# ------------------------------------------------------------------ summaries


def task_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of each column over the windows of a key, with the window count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(c).alias(c) for c in cols])


def describe(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """n, mean, median, sd, sem, 95 % interval (1.96 sem), quartiles and dz per key and feature."""
    long = unpivot_values(df, keys, cols)
    aggs = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    d = agg_with_percentiles(long, [*keys, "feature"], aggs, {"median": ("value", 0.5), "p25": ("value", 0.25), "p75": ("value", 0.75)})
    d = d.withColumn("sem", F.col("sd") / F.sqrt("n"))
    return d.withColumns({"ci_low": F.col("mean") - 1.96 * F.col("sem"), "ci_high": F.col("mean") + 1.96 * F.col("sem"), "dz": ratio("mean", "sd")})


def feature_inventory(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: coverage, zero share, moments, range, IQR, unbiased skew, distinct values."""
    long = unpivot_values(df, [], cols)
    n = F.count("value")
    g1 = F.skewness("value")
    aggs = [
        n.alias("n"), (n / F.count(F.lit(1)) * 100).alias("coverage_pct"), (F.try_divide(F.count_if(F.col("value") == 0), n) * 100).alias("zero_pct"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
    ]
    # apart from the others: beside a distinct count Spark would hold their sketches once for every value
    unique = long.groupBy("feature").agg(F.count_distinct("value").alias("n_unique"))
    d = agg_with_percentiles(long, ["feature"], aggs, {"median": ("value", 0.5), "_q1": ("value", 0.25), "_q3": ("value", 0.75)})
    d = join_on(d, unique, ["feature"], "inner")
    first = [c for c in d.columns if c not in ("n_unique", "median", "_q1", "_q3")]
    return d.select(*first, "n_unique", "median", (F.col("_q3") - F.col("_q1")).alias("iqr"))


def feature_flags(inventory: DataFrame) -> DataFrame:
    """The inventory with what speaks against a feature and how to treat it."""
    c = F.col
    near_constant = (c("n_unique") <= 2) | F.coalesce(c("sd") == 0, F.lit(False))
    flags = {"low_coverage": c("coverage_pct") < 80, "near_constant": near_constant, "sparse_count": F.coalesce(c("zero_pct") >= 80, F.lit(False)),
             "strongly_skewed": F.coalesce(F.abs("skew") >= 1, F.lit(False))}
    # fixed values: the texts of the recommendation
    handling = (F.when(c("near_constant"), "exclude: near constant").when(c("low_coverage"), "review: low coverage").when(c("sparse_count"), "review: sparse count")
                .when(c("strongly_skewed"), "transform or robust-scale").otherwise("eligible for theory review"))
    return inventory.withColumns(flags).withColumn("recommended_handling", handling)


def family_overview(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per family: features, their median coverage, and how many have each flag."""
    n = {"n_low_coverage": "low_coverage", "n_near_constant": "near_constant", "n_sparse": "sparse_count", "n_strongly_skewed": "strongly_skewed"}
    aggs = [F.count(F.lit(1)).alias("n_features"), *[F.count_if(c).alias(k) for k, c in n.items()]]
    return agg_with_percentiles(flagged, keys, aggs, {"median_coverage_pct": ("coverage_pct", 0.5)})


def two_level_mean(df: DataFrame, person: Sequence[str], group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean per person inside a group, then over the group's persons: n, and mean and sd of each column."""
    p = df.groupBy(*dict.fromkeys([*group, *person])).agg(*[F.avg(c).alias(c) for c in cols])
    return p.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))])


def category_shares(df: DataFrame, category: Sequence[str], cols: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each category, their percent (inside ``keys``), and the means of ``cols``."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols]]
    g = with_stats(df.groupBy(*keys, *category).agg(*sums), keys, {"_t": F.sum("n")})
    return g.withColumn("pct", F.col("n") / F.col("_t") * 100).drop("_t")


def rating_table(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, feature): answers, mean, sd, least and largest of each rating."""
    v = F.col("value")
    return unpivot_values(df, keys, cols).groupBy(*keys, "feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def person_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str], task: str, valid: Column | None = None) -> DataFrame:
    """Mean, sd, min, max of each feature per person, tasks seen and valid tasks."""
    aggs = [F.count_distinct(task).alias("n_tasks"), F.count_distinct(F.when(valid if valid is not None else F.lit(True), F.col(task))).alias("n_valid_tasks")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)


def variation(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Coefficient of variation in percent per key."""
    return df.groupBy(*keys).agg((F.stddev_samp(c) / (F.avg(c) + 1e-9) * 100).alias("cv_pct"), F.count(c).alias("n"))


def variation_summary(df: DataFrame, keys: Sequence[str], cols: Sequence[str], min_n: int = 3) -> DataFrame:
    """Per feature, the mean, least and largest coefficient of variation over the keys with ``min_n`` values or more."""
    v = F.col("value")
    cv = unpivot_values(df, keys, cols).groupBy(*keys, "feature").agg((F.stddev_samp(v) / (F.avg(v) + 1e-9) * 100).alias("cv"), F.count(v).alias("n"))
    return cv.filter(F.col("n") >= min_n).groupBy("feature").agg(F.count(F.lit(1)).alias("n_keys"), F.avg("cv").alias("mean"), F.min("cv").alias("min"), F.max("cv").alias("max"))


def disagreement(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sample sd over members per group and measure, long form."""
    return unpivot_values(df, keys, cols).groupBy(*keys, "feature").agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))


def shares(df: DataFrame, keys: Sequence[str], state: str, levels: Sequence) -> DataFrame:
    """Share of rows in each state per key, zero filled."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(*[(F.count_if(F.col(state) == s) / n).alias(f"share_{s}") for s in levels], n.alias("n_rows"))


def state_profiles(df: DataFrame, state: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each feature per state and its z score over the states."""
    m = unpivot_values(df, [state], cols).groupBy(state, "feature").agg(F.avg("value").alias("mean"))
    m = with_stats(m, ["feature"], {"_m": F.avg("mean"), "_s": F.stddev_pop("mean")})
    return m.withColumn("z", F.when(F.col("_s") > 0, (F.col("mean") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


# ------------------------------------------------------------------ association


def pearson_table(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], min_n: int = 3) -> DataFrame:
    """Correlation of every listed pair over its complete rows, all in one aggregate."""
    items = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), corr_or_null(F.col(a).cast("double"), F.col(b).cast("double"), min_n).alias("r")))
    g = df.groupBy(*keys).agg(F.array(*items).alias("_c"))
    return g.select(*keys, F.inline("_c"))


#: Rank tables of a column up to so many rows are broadcast to the rows they rank.
RANKS_SENT = 100_000


def spearman_table(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], min_n: int = 3, rows_per_block: int | None = None) -> DataFrame:
    """Rank correlation of every listed pair over its complete rows.

    The values of each column are counted once, for every partner over the rows that have it; running counts
    rank a value among them. One join a column brings the ranks back to the rows, and one aggregate gives all pairs.
    """
    d, keys, flat = _const(df, keys)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    d = settle(d.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)]))
    out = rank_correlations(d, keys, cols, pairs, min_n, rows_per_block)
    return out.drop("_all") if flat else out


def rank_correlations(d: DataFrame, keys: Sequence[str], cols: Sequence[str], pairs: Sequence[tuple[str, str]], min_n: int = 3, rows_per_block: int | None = None) -> DataFrame:
    """``spearman_table`` of a stored table whose column ``_v{i}`` holds the values of the i-th of ``cols``."""
    at = {c: i for i, c in enumerate(cols)}
    partners = {i: sorted({at[y] for x, y in pairs if at[x] == i} | {at[x] for x, y in pairs if at[y] == i}) for i in at.values()}
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_v")) for i in at.values()])
    there = [F.col(f"_v{j}").isNotNull().alias(f"_p{j}") for j in at.values()]
    counts = d.select(*keys, *there, F.inline(cells)).filter(F.col("_v").isNotNull()).groupBy(*keys, "_c", "_v").agg(*[F.count_if(f"_p{j}").alias(f"_n{j}") for j in at.values()])
    steps = {x: s for j in at.values() for x, s in ((f"_cum{j}", cum_sum(f"_n{j}")), (f"_all{j}", key_sum(f"_n{j}")))}
    ranks = ordered_scan(settle(counts), [*keys, "_c"], ["_v"], steps, rows_per_block)
    # a value's mean rank, less the mean of all ranks
    ranks = settle(ranks.select(*keys, "_c", "_v", *[(F.col(f"_cum{j}") - (F.col(f"_n{j}") + F.col(f"_all{j}")) / 2.0).alias(f"_r{j}") for j in at.values()]))
    sizes = {r["_c"]: r["count"] for r in ranks.groupBy("_c").count().collect()}  # a row a column
    for i, js in partners.items():
        own = ranks.filter(F.col("_c") == i).select(*keys, F.col("_v").alias(f"_v{i}"), *[F.col(f"_r{j}").alias(f"_r{i}_{j}") for j in js])
        d = join_on(d, F.broadcast(own) if sizes.get(i, 0) <= RANKS_SENT else own, [*keys, f"_v{i}"], "left")
    items = []
    for a, b in pairs:
        i, j = at[a], at[b]
        both = F.col(f"_v{i}").isNotNull() & F.col(f"_v{j}").isNotNull()
        x, y = F.col(f"_r{i}_{j}"), F.col(f"_r{j}_{i}")
        n, sxy, sxx, syy = F.count_if(both), F.sum(F.when(both, x * y)), F.sum(F.when(both, x * x)), F.sum(F.when(both, y * y))
        rho = F.when((n >= min_n) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))
        items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), rho.alias("rho")))
    return d.groupBy(*keys).agg(F.array(*items).alias("_c")).select(*keys, F.inline("_c")).filter(F.col("n") > 0)


def all_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def pair_catalogue(df: DataFrame, left: Sequence[str], right: Sequence[str], min_n: int) -> DataFrame:
    """Complete-row count of every left x right column pair and whether it reaches the minimum."""
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n_complete")) for a in left for b in right if a != b]
    return df.agg(F.array(*items).alias("_c")).select(F.inline("_c")).withColumn("enough", F.col("n_complete") >= min_n)


def eta_squared(df: DataFrame, value: str, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """Between-category share of the sum of squares."""
    d, keys, flat = _const(df.filter(F.col(value).isNotNull() & F.col(category).isNotNull()), keys)
    g = d.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    g = with_stats(g, keys, {"_gm": F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")})
    between = F.sum(F.col("_n") * (F.col("_m") - F.col("_gm")) ** 2)
    within = F.sum(F.col("_n") * F.col("_v"))
    out = g.groupBy(*keys).agg(F.sum("_n").alias("n"), F.when(between + within > 0, between / (between + within)).alias("eta_squared"))
    return out.drop("_all") if flat else out


def cronbach(df: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Alpha of the item set and of each set with one item left out, over complete rows."""
    d, keys, flat = _const(df.dropna(subset=list(items)), keys)

    def alpha(cols):
        k = len(cols)
        total = sum((F.col(c) for c in cols), F.lit(0.0))
        tv = F.var_samp(total)
        return F.when(tv > 0, F.lit(k / (k - 1)) * (1 - sum((F.var_samp(c) for c in cols), F.lit(0.0)) / tv)) if k > 1 else F.lit(None).cast("double")

    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), alpha(list(items)).alias("alpha"),
                               *[alpha([c for c in items if c != i]).alias(f"alpha_without_{i}") for i in items])
    return out.drop("_all") if flat else out


def agreement(df: DataFrame, a: str, b: str, positive, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, Cohen kappa, and precision, recall, F1 of ``b`` for the positive label of ``a``."""
    d, keys, flat = _const(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), keys)
    cells = d.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    side = lambda c: cells.groupBy(*keys, F.col(c).alias("_v")).agg(F.sum("_n").alias(f"_s{c}"))
    pe = join_on(side("_a"), side("_b"), [*keys, "_v"], "inner").groupBy(*keys).agg(F.sum(F.col("_s_a") * F.col("_s_b")).alias("_pe"))
    hit = lambda x, y: F.sum(F.when((F.col("_a") == positive if x else F.col("_a") != positive) & (F.col("_b") == positive if y else F.col("_b") != positive), F.col("_n")).otherwise(0))
    g = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"),
        hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    g = join_on(g, pe, keys, "left")
    po, e = F.col("_same") / F.col("n"), F.coalesce("_pe", F.lit(0)) / (F.col("n") * F.col("n"))
    out = g.withColumns({
        "accuracy": po, "kappa": F.when(e < 1, (po - e) / (1 - e)), "precision": ratio("tp", F.col("tp") + F.col("fp")),
        "recall": ratio("tp", F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    }).drop("_same", "_pe")
    return out.drop("_all") if flat else out


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with row shares, expected counts and chi-square terms."""
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    c = with_stats(with_stats(with_stats(c, [a], {"_ra": F.sum("n")}), [b], {"_cb": F.sum("n")}), [], {"_t": F.sum("n")})
    e = F.col("_ra") * F.col("_cb") / F.col("_t")
    return c.withColumns({"row_share": F.col("n") / F.col("_ra"), "expected": e, "chi2_term": (F.col("n") - e) * (F.col("n") - e) / e}).drop("_ra", "_cb", "_t")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square, degrees of freedom, p value and Cramer V; empty cells count through the margins.
    With one level on a side there is no test and p is null."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    d = with_stats(with_stats(cells, [a], {"_ra": F.sum("n")}), [b], {"_cb": F.sum("n")})
    g = d.agg(F.sum(F.col("n") * F.col("n") / (F.col("_ra") * F.col("_cb"))).alias("_s"), F.sum("n").alias("n"),
              F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_c"))
    chi = F.col("n") * (F.col("_s") - 1)
    k = F.least(F.col("_r"), F.col("_c")) - 1
    g = g.withColumns({"chi2": chi, "df": (F.col("_r") - 1) * (F.col("_c") - 1)})
    return g.select("n", "chi2", "df", chi2_tail(F.col("chi2"), F.col("df")).alias("p"), F.when(k > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("n") * k))).alias("cramer_v"))


# ------------------------------------------------------------------ tests


def normal_tail(z: Column) -> Column:
    """Two-sided normal p value by the classic rational approximation (error below 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _series(first: Column, n_terms: Column, ratio_at) -> Column:
    """first + first * ratio_at(1) + ..., ``n_terms`` terms in all."""
    steps = F.when(n_terms > 1, F.sequence(F.lit(1).cast("long"), n_terms.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    grow = lambda s, i: F.struct((s["term"] * ratio_at(i)).alias("term"), (s["sum"] + s["term"] * ratio_at(i)).alias("sum"))
    total = F.aggregate(steps, F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum")), grow, lambda s: s["sum"])
    return F.when(n_terms >= 1, total).otherwise(0.0)


#: Degrees of freedom up to which tails are summed term by term; beyond it they are normal to 1e-6.
SERIES_DF = 1_000


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t for whole degrees of freedom; null for null input or under one degree."""
    nu, odd = df.cast("double"), F.pmod(df.cast("long"), F.lit(2))
    sin, cos2 = F.abs(t) / F.sqrt(nu + t * t), nu / (nu + t * t)
    s = _series(F.when(odd == 1, F.sqrt(cos2)).otherwise(1.0), F.floor((nu - odd) / 2), lambda i: (2 * i - 1 + odd) / (2 * i + odd) * cos2)
    inside = F.when(odd == 1, (F.asin(F.least(sin, F.lit(1.0))) + sin * s) * (2 / np.pi)).otherwise(sin * s)
    far = normal_tail((8 * nu + 1) / (8 * nu + 3) * F.sqrt(nu * F.log1p(t * t / nu)))
    return F.when(t.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double")).when(df > SERIES_DF, far).otherwise(F.greatest(1 - inside, F.lit(0.0)))


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper p value of chi-square for whole degrees of freedom; null for null input or under one degree."""
    x = F.when(x < 0, 0.0).otherwise(x)
    k, odd, y = df.cast("double"), F.pmod(df.cast("long"), F.lit(2)), x / 2
    first = F.when(odd == 1, 2 * F.sqrt(y / np.pi)).otherwise(1.0)
    s = _series(first, F.floor((k - odd) / 2), lambda i: y / (i + odd / 2))
    near = F.exp(-y) * s + F.when(odd == 1, normal_tail(F.sqrt(x))).otherwise(0.0)
    z = (F.cbrt(x / k) - 1 + 2 / (9 * k)) / F.sqrt(2 / (9 * k))
    far = F.when(z > 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)
    return F.when(x.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double")).when((df > SERIES_DF) | (x > 1_400), far).otherwise(F.least(near, F.lit(1.0)))


def with_p_and_q(table: DataFrame, r: str, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A table of correlations (columns ``r`` and n) with p of the t test on n - 2 degrees and q over ``keys``.

    Null correlations, and those of fewer than three rows, have null p and q and do not count among the tests.
    """
    c, nu = F.col(r), F.col("n") - 2
    t = F.abs(c) * F.sqrt(F.try_divide(F.greatest(nu, F.lit(0)).cast("double"), 1 - c * c))
    p = F.when(c.isNull() | (nu < 1), F.lit(None).cast("double")).when(F.abs(c) >= 1, 0.0).otherwise(t_tail(t, nu))
    return fdr(table.withColumn("p", p), keys, "p", tie)


#: Exact null distributions: up to so many differences (signed ranks), or so many values in the smaller group (rank sums).
EXACT_SIGNED, EXACT_SMALLER = 50, 8
_EXACT_CELLS = 20_000_000


@lru_cache(256)
def _signed_rank_share(n: int) -> np.ndarray:
    """P(W <= w) for w = 0, 1, ...: of the 2^n sign patterns of the ranks 1..n, those whose positive ranks add up to w at most."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1.0
    for r in range(1, n + 1):
        c[r:] += c[:-r].copy()
    return np.cumsum(c) / 2.0**n


@lru_cache(256)
def _rank_sum_share(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u = 0 .. m n / 2: arrangements of m among n + m values, counted by partitions in an m x n box."""
    top = m * n // 2
    c = np.zeros(top + 1)
    c[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= top:  # times 1 - q^(n + i)
            c[n + i :] -= c[: top + 1 - n - i].copy()
        for j in range(i):  # over 1 - q^i
            c[j::i] = np.cumsum(c[j::i])
    return np.cumsum(c) / comb(n + m, m)


def signed_rank_p(w: Column, m: Column) -> Column:
    """Two-sided exact p of the smaller rank sum ``w`` of ``m`` differences without ties."""

    @F.pandas_udf("double")
    def p(w: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or not 1 <= b <= EXACT_SIGNED else min(1.0, 2 * _signed_rank_share(int(b))[int(a)]) for a, b in zip(w, m)], dtype=float)

    return p(w, m)


def rank_sum_p(u: Column, a: Column, b: Column) -> Column:
    """Two-sided exact p of ``u`` for groups of ``a`` and ``b`` values without ties; null where it is out of reach."""

    @F.pandas_udf("double")
    def p(u: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, m, n in zip(u, a, b):
            ok = not (pd.isna(x) or pd.isna(m) or pd.isna(n)) and 1 <= min(m, n) <= EXACT_SMALLER and m * n <= _EXACT_CELLS
            out.append(min(1.0, 2 * _rank_sum_share(int(min(m, n)), int(max(m, n)))[int(min(x, m * n - x))]) if ok else None)
        return pd.Series(out, dtype=float)

    return p(u, a, b)


def paired_contrasts(df: DataFrame, person: Sequence[str], task: str, value: str, tasks: Sequence[str], min_n: int = 3) -> DataFrame:
    """Every task pair: n, means, mean difference, paired t with p and q, Wilcoxon W and z with p and q, dz; the tests are
    null under ``min_n``, Wilcoxon's under five pairs. Its p is exact for up to EXACT_SIGNED differences without ties
    or zeros, else normal. The q values are over all pairs of tasks.

    People are pivoted to one row first, so no self join is needed.
    """
    w = df.filter(F.col(task).isin(*tasks)).groupBy(*person).agg(*[F.avg(F.when(F.col(task) == t, F.col(value))).alias(f"_v{i}") for i, t in enumerate(tasks)])
    opts = F.array(*[F.struct(F.lit(tasks[i]).alias("task_a"), F.lit(tasks[j]).alias("task_b"), F.col(f"_v{i}").alias("x"), F.col(f"_v{j}").alias("y"))
                     for i, j in combinations(range(len(tasks)), 2)])
    p = w.select(F.inline(opts)).filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("d", F.col("y") - F.col("x"))
    pk = ["task_a", "task_b"]
    base = p.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("_sd"))
    nz = p.filter("d <> 0").withColumn("ad", F.round(F.abs("d"), 9)).groupBy(*pk, "ad").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("pos"))
    r = value_ranks(nz, pk, "ad", "c").select(*pk, "ad", "avg_rank", "total")
    s = join_on(nz, r, [*pk, "ad"], "inner").groupBy(*pk).agg(
        F.sum(F.col("pos") * F.col("avg_rank")).alias("w_plus"), F.max("total").alias("_m"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("_tie"))
    m = F.col("_m")
    s = s.withColumn("w", F.least(F.col("w_plus"), m * (m + 1) / 2 - F.col("w_plus")))
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("_tie") / 48
    s = s.withColumn("z", F.when(var > 0, (F.col("w") - m * (m + 1) / 4) / F.sqrt(var)))
    out = base.join(s, pk, "left").withColumns({"_exact": signed_rank_p(F.col("w"), m), "t": F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.col("_sd") / F.sqrt("n"))), "dz": ratio("mean_diff", "_sd"), "p_wilcoxon": normal_tail(F.col("z"))})
    plain = (F.col("_tie") == 0) & (F.col("_m") == F.col("n")) & (F.col("n") <= EXACT_SIGNED)
    out = out.withColumn("p_wilcoxon", F.when(plain, F.col("_exact")).otherwise(F.col("p_wilcoxon")))
    out = out.withColumn("p_t", t_tail(F.col("t"), F.col("n") - 1))
    least = {"w": max(min_n, 5), "z": max(min_n, 5), "p_wilcoxon": max(min_n, 5)}
    tests = {c: F.when(F.col("n") >= least.get(c, min_n), F.col(c)) for c in ("t", "p_t", "dz", "w", "z", "p_wilcoxon")}
    out = settle(out.withColumns(tests).drop("_sd", "_m", "_tie", "w_plus", "_exact"))
    return fdr(fdr(out, [], "p_t", pk, "q_t"), [], "p_wilcoxon", pk, "q_wilcoxon")


def rank_sums(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Per key and group: n and sum of average ranks; per key: total and tie term."""
    c = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_c"))
    c = settle(c)
    r = value_ranks(c, keys, value, "_c").select(*keys, value, "avg_rank", "total", F.col("n").alias("_t"))
    j = join_on(c, r, [*keys, value], "inner")
    g = j.groupBy(*keys, group).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("avg_rank")).alias("rank_sum"), F.max("total").alias("total"))
    t = F.col("n").cast("double")
    ties = r.withColumnRenamed("_t", "n").groupBy(*keys).agg(F.sum(t * t * t - t).alias("ties"))
    return join_on(g, ties, keys, "left")


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, a, b, min_n: int = 5) -> DataFrame:
    """U of group a, its normal z (tie corrected), p and Cohen d; keys with fewer than ``min_n`` values in a group are left out.

    p is exact where the smaller group has at most EXACT_SMALLER values and nothing is tied, else normal with a
    continuity step of a half.
    """
    d, keys, flat = _const(df.filter(F.col(group).isin(a, b)), keys)
    r = rank_sums(d, keys, group, value)
    pick = lambda v, c: F.max(F.when(F.col(group) == v, F.col(c)))
    g = r.groupBy(*keys).agg(pick(a, "n").alias("n_a"), pick(b, "n").alias("n_b"), pick(a, "rank_sum").alias("_ra"), F.max("ties").alias("_t"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_ra") - na * (na + 1) / 2
    var = na * nb / 12 * ((n + 1) - F.col("_t") / (n * (n - 1)))
    g = g.withColumns({"u": u, "z": F.when(var > 0, (u - na * nb / 2) / F.sqrt(var))})
    step = F.greatest(F.abs(F.col("u") - na * nb / 2) - 0.5, F.lit(0.0)) / F.sqrt(var)
    exact = F.when(F.col("_t") == 0, rank_sum_p(F.col("u"), na, nb))
    g = g.filter((na >= min_n) & (nb >= min_n)).withColumn("p", F.coalesce(exact, F.when(var > 0, normal_tail(step)).otherwise(F.when(var == 0, 1.0)))).drop("_ra", "_t")
    m = d.groupBy(*keys).agg(*[f(F.when(F.col(group) == v, F.col(value))).alias(k) for f, v, k in (
        (F.avg, a, "_ma"), (F.avg, b, "_mb"), (F.var_samp, a, "_va"), (F.var_samp, b, "_vb"))])
    g = join_on(g, m, keys, "left")
    pooled = F.sqrt(((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb")) / (n - 2))
    out = g.withColumn("cohen_d", F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / pooled)).drop("_ma", "_mb", "_va", "_vb")
    return out.drop("_all") if flat else out


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str, min_n: int = 1) -> DataFrame:
    """Kruskal-Wallis H with tie correction, its chi-square p, number of groups and rows.

    Groups with fewer than ``min_n`` values are left out before ranking; p is null with fewer than two groups.
    """
    d, keys, flat = _const(df, keys)
    if min_n > 1:
        d = with_stats(d, [*keys, group], {"_gn": F.count(value)}).filter(F.col("_gn") >= min_n).drop("_gn")
    r = rank_sums(d, keys, group, value)
    s, n = F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")), F.max("total").cast("double")
    fix = 1 - F.max("ties") / (n * n * n - n)
    out = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max("total").alias("n"), F.when(fix > 0, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / fix).alias("h"))
    out = out.withColumn("p", chi2_tail(F.col("h"), F.col("k") - 1))
    return out.drop("_all") if flat else out


def fdr(df: DataFrame, keys: Sequence[str], p: str, tie: Sequence[str], out: str = "q", rows_per_block: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q values per key; null p values stay null."""
    d, keys, flat = _const(df, keys)
    last = F.coalesce(F.col(p), F.lit(2.0))  # null p values rank behind all others
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    steps = {"_rank": row_no(), "_n": key_sum(F.col(p).isNotNull().cast("long"))}
    res = ordered_scan(d, keys, [last, *tie], steps, rows_per_block, then=[({"_raw": raw}, {"_q": rev_min("_raw")})])
    res = res.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.col("_q"), F.lit(1.0)))).drop("_rank", "_n", "_raw", "_q")
    return res.drop("_all") if flat else res


# ------------------------------------------------------------------ audits


def window_contiguity(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Windows present, span, gaps and duplicates of the window index of each key."""
    n, u = F.count(index), F.count_distinct(index)
    span = F.max(index) - F.min(index) + 1
    return df.groupBy(*keys).agg(n.alias("n_rows"), u.alias("n_windows"), span.alias("span"), (span - u).alias("n_gaps"), (n - u).alias("n_duplicates"), (span == u).alias("contiguous"))


def cell_validity(df: DataFrame, keys: Sequence[str], valid: Column, members: int) -> DataFrame:
    """Per group window: valid member cells, any and all valid, against the expected member count."""
    k = F.count_if(valid)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), k.alias("n_valid"), (k > 0).alias("any_valid"), (k >= members).alias("all_valid"))


def usability(grid: DataFrame, keys: Sequence[str], by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Counts and percent of expected rows on which each condition holds, per ``by``."""
    aggs = [F.count(F.lit(1)).alias("n_expected")]
    for name, c in flags.items():
        hit = F.count_if(F.coalesce(c, F.lit(False)))
        aggs += [hit.alias(f"n_{name}"), (hit / F.count(F.lit(1)) * 100).alias(f"pct_{name}")]
    return grid.groupBy(*by).agg(*aggs)


def flag_frequencies(df: DataFrame, keys: Sequence[str], flags: str, sep: str = ";") -> DataFrame:
    """How often each flag of a joined flag text occurs, with percent of rows."""
    d = with_stats(df.select(*keys, flags), keys, {"_t": F.count(F.lit(1))})
    e = d.select(*keys, "_t", F.explode(F.split(flags, sep)).alias("flag")).filter("flag <> ''")
    return e.groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max("_t") * 100).alias("pct"))


def step_audit(before: DataFrame, after: DataFrame, keys: Sequence[str], cols: Sequence[str], step: str) -> DataFrame:
    """Per column: nulls before and after, new nulls, changed values."""
    b = before.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    a = after.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in cols])
    j = join_on(b, a, keys, "inner")
    items = []
    for c in cols:
        x, y = F.col(c), F.col(f"_a_{c}")
        items.append(F.struct(F.lit(c).alias("feature"), F.count_if(x.isNull()).alias("nulls_before"), F.count_if(y.isNull()).alias("nulls_after"),
                              F.count_if(x.isNotNull() & y.isNull()).alias("new_nulls"), F.count_if(x.isNotNull() & y.isNotNull() & (x != y)).alias("changed")))
    return j.agg(F.array(*items).alias("_s")).select(F.lit(step).alias("step"), F.inline("_s"))


def shared_attention(df: DataFrame, keys: Sequence[str], bin_col: str, person: str, zone: str) -> DataFrame:
    """Per zone and bin: sum over people of their share of samples in the zone."""
    c = df.groupBy(*keys, bin_col, person, zone).agg(F.count(F.lit(1)).alias("_n"))
    c = with_stats(c, [*keys, bin_col, person], {"_t": F.sum("_n")})
    return c.groupBy(*keys, bin_col, zone).agg(F.sum(F.col("_n") / F.col("_t")).alias("attention"), F.count(F.lit(1)).alias("n_people"))


def clock_quality(df: DataFrame, keys: Sequence[str], order: Sequence, t: str, rows_per_block: int | None = None) -> DataFrame:
    """Monotone flag, largest gap, rate, median step and its MAD along the recorded order."""
    d = ordered_scan(df, keys, order, {"_p": prev(t)}, rows_per_block).withColumn("_dt", F.col(t) - F.col("_p"))
    span = F.max(t) - F.min(t)
    aggs = [F.count(F.lit(1)).alias("n"), (F.coalesce(F.min("_dt"), F.lit(0.0)) >= 0).alias("monotone"), F.max("_dt").alias("max_gap"), F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("rate")]
    g = agg_with_percentiles(d, keys, aggs, {"median_step": ("_dt", 0.5)})
    dev = join_on(d.select(*keys, "_dt"), g.select(*keys, "median_step"), keys, "left").withColumn("_dev", F.abs(F.col("_dt") - F.col("median_step")))
    return join_on(g, exact_percentiles(dev, keys, {"mad_step": ("_dev", 0.5)}), keys, "left")


def clock_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares y = scale x + offset, mean absolute residual and drift in ppm."""
    f = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("scale"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("n"))
    r = join_on(df.select(*keys, x, y), f, keys, "left")
    r = r.withColumn("_e", F.abs(F.col(y) - F.col("_my") - F.col("scale") * (F.col(x) - F.col("_mx"))))
    res = r.groupBy(*keys).agg(F.avg("_e").alias("mean_abs_residual"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    f = f.withColumns({"offset": F.col("_my") - F.col("scale") * F.col("_mx"), "drift_ppm": (F.col("scale") - 1) * 1e6}).drop("_mx", "_my")
    return join_on(f, res, keys, "left")


def piecewise_clock_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, chunk: int, rows_per_block: int | None = None) -> DataFrame:
    """One fit per run of ``chunk`` rows in x order, with the x where it starts."""
    d = ordered_scan(df, keys, [x], {"_no": row_no()}, rows_per_block).withColumn("chunk", F.floor((F.col("_no") - 1) / chunk))
    ck = [*keys, "chunk"]
    return join_on(clock_fit(d, ck, x, y), d.groupBy(*ck).agg(F.min(x).alias("t0")), ck, "left")


def better_fit(a: DataFrame, b: DataFrame, keys: Sequence[str], error: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The fit with the lower error per key, the first on ties, the only one if one."""
    ca = [c for c in a.columns if c not in keys]
    l = a.select(*keys, F.struct(*ca).alias("_x"))
    r = b.select(*keys, F.struct(*ca).alias("_y"))
    j = l.join(r, list(keys), "full")
    first = F.col("_y").isNull() | (F.col("_x").isNotNull() & (F.col(f"_x.{error}") <= F.col(f"_y.{error}")))
    j = j.withColumns({"_b": F.when(first, F.col("_x")).otherwise(F.col("_y")), "chosen": F.when(first, names[0]).otherwise(names[1])})
    return j.select(*keys, "chosen", *[F.col(f"_b.{c}").alias(c) for c in ca])


def feed_offsets(df: DataFrame, feed: str, t: str, projected: Column, limit: float) -> DataFrame:
    """Start offset of each feed: its median projected clock minus the median over feeds; too far ones are dropped."""
    d = df.withColumn("_o", projected)
    m = exact_percentiles(d, [feed], {"_m": ("_o", 0.5)})
    mid = exact_percentiles(m, [], {"_mm": ("_m", 0.5)})
    out = m.withColumn("_mid", mid.select("_mm").scalar()).withColumn("start_offset", F.col("_m") - F.col("_mid"))
    return out.filter(F.abs("start_offset") <= limit).select(feed, "start_offset")


def discordance(df: DataFrame, signal: str, rating: str, threshold: float = 1.0) -> DataFrame:
    """|z(signal) - z(rating)| with flags for calm-but-aroused and the reverse."""
    d = with_stats(df, [], {"_ms": F.avg(signal), "_ds": F.stddev_samp(signal), "_mr": F.avg(rating), "_dr": F.stddev_samp(rating)})
    zs = F.when(F.col("_ds") > 0, (F.col(signal) - F.col("_ms")) / F.col("_ds"))
    zr = F.when(F.col("_dr") > 0, (F.col(rating) - F.col("_mr")) / F.col("_dr"))
    d = d.withColumns({"z_signal": zs, "z_rating": zr}).drop("_ms", "_ds", "_mr", "_dr")
    return d.withColumns({
        "discordance": F.abs(F.col("z_signal") - F.col("z_rating")), "signal_over_rating": (F.col("z_signal") - F.col("z_rating")) > threshold,
        "rating_over_signal": (F.col("z_rating") - F.col("z_signal")) > threshold})


def annotation_context(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], t: str) -> DataFrame:
    """Events by type, total and time span per key."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count(F.lit(1)).alias("n_events"), (F.max(t) - F.min(t)).alias("span_s"))


def item_coverage(df: DataFrame, item: str, task: str, tasks: Sequence[str], value: str) -> DataFrame:
    """Answers per item and task."""
    return df.groupBy(item).agg(*[F.count(F.when(F.col(task) == t, F.col(value))).alias(f"n_{t}") for t in tasks])


def response_quality(df: DataFrame, unit: Sequence[str], kind: str, kinds: Sequence[str], item: str, expected: Mapping[str, int]) -> DataFrame:
    """Per unit: presence of each response type, distinct items against the expected count, completion."""
    aggs = [F.count(F.lit(1)).alias("n_responses")]
    for k in kinds:
        aggs += [F.count_if(F.col(kind) == k).alias(f"n_{k}"), (F.count_if(F.col(kind) == k) > 0).alias(f"has_{k}"), F.count_distinct(F.when(F.col(kind) == k, F.col(item))).alias(f"items_{k}")]
    g = df.groupBy(*unit).agg(*aggs)
    done = F.lit(True)
    new = {}
    for k, n in expected.items():
        new[f"complete_pct_{k}"] = F.least(F.col(f"items_{k}") / F.lit(float(n)), F.lit(1.0)) * 100
        done = done & (F.col(f"items_{k}") >= n)
    return g.withColumns({**new, "complete": done})


def response_units(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    """One row per unit (say session, group, participant, task) that gave any response; units with a null part are left out."""
    return df.select(*unit).dropna().distinct()


def completion_summary(units: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Per task: groups and units seen."""
    return units.groupBy(*by).agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_units"))


def stream_presence(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """1 or 0 per key and response type, and whether all are there; keys without any of them are left out."""
    there = [F.max((F.col(kind) == k).cast("int")).alias(str(k)) for k in kinds]
    d = df.filter(F.col(kind).isin(*kinds)).groupBy(*keys).agg(*there)
    return d.withColumn("all_streams_present", F.least(*[F.col(f"`{k}`") for k in kinds]) if len(kinds) > 1 else F.col(f"`{kinds[0]}`"))


def item_completeness(answers: DataFrame, units: DataFrame, unit: Sequence[str], task: str, item: str, value: str, order: str) -> DataFrame:
    """Per task and item: units that answered (the first answer by ``order`` counts), mean, sd, and those expected.

    Every unit of a task is expected to answer each of its items.
    """
    first = answers.groupBy(*dict.fromkeys([*unit, task]), item).agg(F.min_by(value, order).alias("_v"))
    n = first.groupBy(task, item).agg(F.count("_v").alias("n_present"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    d = join_on(n, units.groupBy(task).agg(F.count(F.lit(1)).alias("expected_units")), [task], "left").withColumn("expected_units", F.coalesce("expected_units", F.lit(0)))
    return d.withColumns({"n_missing": F.col("expected_units") - F.col("n_present"), "pct_present": F.try_divide(100.0 * F.col("n_present"), F.col("expected_units"))})


def core_completeness(items: DataFrame, task: str, item: str, core: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per task, over its core items: items, answers present, expected and missing."""
    wanted = reduce(lambda a, b: a | b, [(F.col(task) == t) & F.col(item).isin(*names) for t, names in core.items()], F.lit(False))
    n_items = F.coalesce(*[F.when(F.col(task) == t, F.lit(len(names))) for t, names in core.items()], F.lit(0))
    d = items.filter(wanted).groupBy(task).agg(*[F.sum(c).alias(k) for k, c in (("n_present", "n_present"), ("n_expected", "expected_units"), ("n_missing", "n_missing"))])
    return d.withColumns({"n_items": n_items, "pct_present": F.try_divide(100.0 * F.col("n_present"), F.col("n_expected"))})


def scale_means(answers: DataFrame, unit: Sequence[str], item: str, value: str, of_scale: Column, out: str) -> DataFrame:
    """Mean of a unit's answers to the items of one scale."""
    return answers.filter(of_scale).groupBy(*unit).agg(F.avg(value).alias(out))


# ------------------------------------------------------------------ models in closed form


def gram_row(df: DataFrame, cols: Sequence[str]):
    """Centred cross products of the columns over complete rows, as one small driver row: means, n, covariance matrix."""
    d = df.dropna(subset=list(cols))
    names = list(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]
    aggs += [F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    r = d.agg(*aggs).first()
    k = len(names)
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(k)]), cov


def residualise(df: DataFrame, y: str, covariates: Sequence[str], out: str) -> DataFrame:
    """y minus its least-squares fit on the covariates; only p x p sums reach the driver."""
    _, m, cov = gram_row(df, [*covariates, y])
    k = len(covariates)
    beta = np.linalg.lstsq(cov[:k, :k], cov[:k, k], rcond=None)[0]
    fit = sum((F.lit(float(b)) * (F.col(c) - F.lit(float(mu))) for b, c, mu in zip(beta, covariates, m)), F.lit(float(m[k])))
    return df.withColumn(out, F.col(y) - fit)


def partial_correlation(df: DataFrame, x: str, y: str, z: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y with one covariate taken out, from three correlations in one aggregate."""
    d, keys, flat = _const(df.dropna(subset=[x, y, z]), keys)
    a, b, c = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(a - b * c, F.sqrt(F.greatest((1 - b * b) * (1 - c * c), F.lit(0.0)))).alias("partial_r"))
    return out.drop("_all") if flat else out


def team_diversity(df: DataFrame, keys: Sequence[str], traits: Sequence[str], rows_per_tile: int = 256) -> DataFrame:
    """Mean pairwise Euclidean distance of the members' trait vectors and spread of each trait.

    Equal vectors are counted first. The distinct ones are dealt into tiles of about ``rows_per_tile``, and each
    pair of tiles is a task's row of its own, so a big group is spread and no task holds more than two tiles of it.
    """
    spread = [f(c).alias(f"{c}_{k}") for c in traits for f, k in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "min"), (F.max, "max"))]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), *spread)
    vec = F.array(*[F.col(c).cast("double") for c in traits])
    d = df.dropna(subset=list(traits)).groupBy(*keys, vec.alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    d = join_on(d, g.select(*keys, F.ceil(F.col("n_members") / rows_per_tile).cast("int").alias("_nt")), keys, "inner")
    tiles = d.groupBy(*keys, "_nt", F.pmod(F.xxhash64("_v"), "_nt").cast("int").alias("_t")).agg(F.collect_list(F.struct("_v", "_w")).alias("_m"))
    left = tiles.select(*keys, F.col("_t").alias("_i"), F.explode(F.sequence("_t", F.col("_nt") - 1)).alias("_j"), F.col("_m").alias("_a"))
    right = tiles.select(*keys, F.explode(F.sequence(F.lit(0), "_t")).alias("_i"), F.col("_t").alias("_j"), F.col("_m").alias("_b"))
    far = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    each = lambda x: F.aggregate("_b", F.lit(0.0), lambda s, y: s + y["_w"] * far(x["_v"], y["_v"]))
    total = F.aggregate("_a", F.lit(0.0), lambda s, x: s + x["_w"] * each(x)) * F.when(F.col("_i") == F.col("_j"), 1.0).otherwise(2.0)
    sums = join_on(left, right, [*keys, "_i", "_j"], "inner").groupBy(*keys).agg(F.sum(total).alias("_s"))
    k = F.col("_k")
    v = join_on(d.groupBy(*keys).agg(F.sum("_w").alias("_k")), sums, keys, "inner")
    return join_on(g, v.select(*keys, F.when(k > 1, F.col("_s") / (k * (k - 1))).alias("mean_distance")), keys, "left")


def adjusted_rand(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings from contingency counts, per key."""
    df, keys, flat = _const(df, keys)
    c = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    two = lambda x: F.sum(x * (x - 1) / 2)
    cells = c.groupBy(*keys).agg(two(F.col("_n")).alias("ij"), F.sum("_n").alias("n"))
    ra = c.groupBy(*keys, "_a").agg(F.sum("_n").alias("_m")).groupBy(*keys).agg(two(F.col("_m")).alias("i"))
    rb = c.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).groupBy(*keys).agg(two(F.col("_m")).alias("j"))
    d = join_on(join_on(cells, ra, keys), rb, keys)
    n = F.col("n")
    e = F.col("i") * F.col("j") / (n * (n - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2
    return d.select(*([] if flat else keys), n.cast("long").alias("n"), F.when(top != e, (F.col("ij") - e) / (top - e)).otherwise(1.0).alias("ari"))


def _best_matching(m: np.ndarray) -> float:
    """Largest sum of cells with at most one in a row and column, by shortest augmenting paths."""
    cost = -(m if m.shape[0] <= m.shape[1] else m.T)
    n, k = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(k), np.full(k, -1)
    for start in range(n):
        dist, via, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        row, col, base = start, -1, 0.0
        while row >= 0:
            step = base + cost[row] - row_price[row] - col_price
            nearer = ~done & (step < dist)
            dist[nearer], via[nearer] = step[nearer], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[col], row = dist[col], True, owner[col]
        taken = done & (owner >= 0)
        row_price[start] += base
        row_price[owner[taken]] += base - dist[taken]
        col_price[done] -= base - dist[done]
        while col >= 0:
            owner[col] = owner[via[col]] if via[col] >= 0 else start
            col = via[col]
    held = owner >= 0
    return float(-cost[owner[held], np.flatnonzero(held)].sum())


def matched_agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and the share of them that agree under the best one-to-one label matching, per key.

    Rows are counted per pair of labels first; a task then matches the labels of a key from those counts, whose number is
    bounded by the labels (states, clusters), not by the rows. A null label is a label of its own; no rows, no result row.
    """
    cells = df.groupBy(*keys, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))

    def match(pdf):
        m = pdf.assign(_a=pdf["_a"].factorize(use_na_sentinel=False)[0], _b=pdf["_b"].factorize(use_na_sentinel=False)[0])
        table = m.pivot_table(index="_a", columns="_b", values="_n", aggfunc="sum", fill_value=0).to_numpy(float)
        return pdf.head(1).assign(n=int(pdf["_n"].sum()), agreement=_best_matching(table) / table.sum())[[*keys, "n", "agreement"]]

    names = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return cells.groupBy(*keys).applyInPandas(match, names + "n long, agreement double")


def group_bootstrap_r2(df: DataFrame, group: str, y: str, pred: str, n_boot: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """R2 with an interval from resampling whole groups: group sums are reweighted, rows are read once."""
    from gatherline.operators.sampling import replicate_sums

    e = F.col(y) - F.col(pred)
    parts = ["_n", "_s", "_q", "_e"]
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_q"), F.sum(e * e).alias("_e"))
    r2 = lambda n, s, q, left: 1 - left / F.nullif(q - s * s / n, F.lit(0.0))
    reps = replicate_sums(g, [], group, parts, n_boot, seed).filter("_w > 0").select(r2(*[F.col(f"_s{i}") for i in range(4)]).alias("_r"))
    tail = (1 - level) / 2
    q = exact_percentiles(reps, [], {"ci_low": ("_r", tail), "ci_high": ("_r", 1 - tail)})
    point = g.agg(r2(*[F.sum(c).cast("double") for c in parts]).alias("r2"), F.count(F.lit(1)).alias("n_groups"))
    return point.withColumn("_q", q.select(F.struct("ci_low", "ci_high").alias("s")).scalar()).select("r2", "n_groups", "_q.*")
