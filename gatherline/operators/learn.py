"""Screening, scaling, grouping and grouped cross-validation.

Linear models work on cross products: one pass gives them per group, a fold is the
total minus a group, and the small solves run inside tasks, one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.operators.clean import plausibility_gate
from gatherline.operators.groups import robust_z, winsorise, with_stats
from gatherline.operators.ordered import exact_percentiles, join_on, ordered_scan, row_no, settle, unpivot_values, value_ranks
from gatherline.operators.stats import pearson_table, rank_correlations, spearman_table

#: Penalties of the ridge (fixed values).
ALPHAS = tuple(float(a) for a in np.logspace(-2, 3, 12))
#: Groups that are folds of their own when a penalty is chosen; more are dealt into that many folds.
INNER_FOLDS = 30
#: Rows whose outcomes are shuffled together.
PERMUTED_ROWS = 50_000


# ------------------------------------------------------------------ scaling and screening


def impute_standardise(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Mean impute, then centre and scale by the population sd of the imputed column."""
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"] = F.avg(c)
        # imputed rows add nothing to the squares
        aggs[f"_d_{c}"] = F.sqrt(F.var_pop(c) * F.count(c) / F.count(F.lit(1)))
    d = with_stats(df, [], aggs)
    z = {c + suffix: F.when(F.col(f"_d_{c}") > 0, (F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}")) / F.col(f"_d_{c}")).otherwise(0.0) for c in cols}
    return d.withColumns(z).drop(*aggs)


def feature_screen(df: DataFrame, cols: Sequence[str], min_coverage: float = 0.8, max_zero: float = 0.8, min_var: float = 1e-4) -> DataFrame:
    """Per feature: coverage, zero share, variance, and whether it is eligible."""
    n = F.count(F.lit(1))
    s = unpivot_values(df, [], cols).groupBy("feature").agg(
        (F.count("value") / n).alias("coverage"), F.try_divide(F.count_if(F.col("value") == 0), F.count("value")).alias("zero_share"), F.var_samp("value").alias("variance"))
    ok = (F.col("coverage") >= min_coverage) & (F.col("zero_share") < max_zero) & (F.col("variance") >= min_var)
    return s.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def eligible_columns(df: DataFrame, cols: Sequence[str], **kw) -> list[str]:
    """The eligible columns, in the order given (one row per column reaches the driver)."""
    ok = {r["feature"] for r in feature_screen(df, cols, **kw).filter("eligible").select("feature").collect()}
    return [c for c in cols if c in ok]


def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95, rank: bool = False) -> DataFrame:
    """For every column, the strongest |r| with an EARLIER column and whether it is redundant.

    A column goes when it matches any earlier one, also one that goes itself.
    """
    pairs = [(cols[i], cols[j]) for j in range(len(cols)) for i in range(j)]
    t = spearman_table(df, [], pairs).withColumnRenamed("rho", "r") if rank else pearson_table(df, [], pairs)
    g = t.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("r")).alias("strongest"))
    return g.withColumn("redundant", F.coalesce(F.col("strongest") > threshold, F.lit(False)))


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    if len(cols) < 2:
        return list(cols)
    out = {r["feature"] for r in correlated_columns(df, cols, threshold).filter("redundant").select("feature").collect()}
    return [c for c in cols if c not in out]


def clean_features(df: DataFrame, person: Sequence[str], cols: Sequence[str], bounds: dict, active=None, n_sd: float = 3.0, keep_raw: bool = False) -> tuple[DataFrame, list[str]]:
    """Gate, winsorise, robust z per person from active rows, then screen and thin the columns."""
    d = winsorise(plausibility_gate(df, bounds), cols, n_sd)
    for c in cols:
        d = robust_z(d, person, c, f"_rz_{c}", active, keep_raw)
    d = d.withColumns({c: F.col(f"_rz_{c}") for c in cols}).drop(*[f"_rz_{c}" for c in cols])
    keep = drop_correlated(d, eligible_columns(d, cols, min_coverage=0.5, max_zero=1.01), 0.95)
    return d.drop(*[c for c in cols if c not in keep]), keep


# ------------------------------------------------------------------ components and clusters


def assemble(df: DataFrame, cols: Sequence[str] | str, out: str = "features") -> DataFrame:
    """ML vector from numeric columns or one array column."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def principal_components(df: DataFrame, features: str, share: float = 0.8, out: str = "components") -> tuple[DataFrame, np.ndarray]:
    """Scores on the first components that reach ``share`` of the variance; signs make the largest loading positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    s = StandardScaler(withMean=True, inputCol=features, outputCol="_std").fit(df).transform(df)
    dim = len(s.select("_std").first()["_std"])
    m = PCA(k=dim, inputCol="_std", outputCol="_pc").fit(s)
    ev = np.asarray(m.explainedVariance.toArray())
    k = int(np.searchsorted(np.cumsum(ev), share - 1e-12) + 1)
    load = m.pc.toArray()[:, :k]
    signs = np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    arr = vector_to_array("_pc")
    scores = F.array(*[F.get(arr, F.lit(i)) * F.lit(float(signs[i])) for i in range(k)])
    return m.transform(s).withColumn(out, scores).drop("_std", "_pc"), ev[:k]


def kmeans_sweep(df: DataFrame, features: str, ks: Sequence[int] = range(2, 8), seed: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """Clusters at the best mean silhouette (squared Euclidean) over ``ks``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    scores, models = {}, {}
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    for k in ks:
        models[k] = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
        scores[k] = ev.evaluate(models[k].transform(df))
    best = max(scores, key=lambda k: (scores[k], -k))
    return models[best].transform(df), scores


def gaussian_mixture(df: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    """Clusters and memberships of a mixture fitted on all rows; equal vectors are one, weighted by their number."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    counts = settle(df.select(vector_to_array(features).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    g = GaussianMixture(k=k, seed=seed, featuresCol=features, weightCol="_w", predictionCol="cluster", probabilityCol="membership")
    return g.fit(counts.select(array_to_vector("_v").alias(features), "_w")).transform(df)


# ------------------------------------------------------------------ ridge over left-out groups


def group_sums(df: DataFrame, group: str, xs: Sequence[str], ys: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """(group, v): the sums that ridge needs of each group, from complete rows, and the global means they are centred on.

    v holds n, the sums of xs, their products (p x p), and for each outcome its sum, its products with xs and its square.
    """
    xs, ys = list(xs), list(ys)
    d = df.dropna(subset=[*xs, *ys])
    means = np.array([v or 0.0 for v in d.agg(*[F.avg(c) for c in [*xs, *ys]]).first()])
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(xs, means)]
    y = [F.col(c) - F.lit(float(m)) for c, m in zip(ys, means[len(xs):])]
    cells = [F.count(F.lit(1)).cast("double"), *[F.sum(a) for a in x], *[F.sum(a * b) for a in x for b in x]]
    for t in y:
        cells += [F.sum(t), *[F.sum(a * t) for a in x], F.sum(t * t)]
    return d.groupBy(group).agg(F.array(*cells).alias("v")), means


class _Sums:
    """One row of sums, cut up: n, xs, products, and (outcome, ...) arrays."""

    def __init__(self, v: np.ndarray, p: int):
        v = np.asarray(v, float)
        self.n, self.sx, self.xx = v[0], v[1 : 1 + p], v[1 + p : 1 + p + p * p].reshape(p, p)
        rest = v[1 + p + p * p :].reshape(-1, p + 2)
        self.sy, self.xy, self.yy = rest[:, 0], rest[:, 1:-1].T, rest[:, -1]

    def errors(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared error of predictions b + x w for each (penalty, outcome)."""
        quad = np.einsum("apt,pq,aqt->at", w, self.xx, w)
        return self.yy - 2 * b * self.sy - 2 * np.einsum("apt,pt->at", w, self.xy) + self.n * b * b + 2 * b * np.einsum("apt,p->at", w, self.sx) + quad


def _ridge(s: _Sums, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (penalty, x, outcome) and intercepts on the raw scale; features are standardised by the training sums."""
    mu, my = s.sx / s.n, s.sy / s.n
    cov = s.xx / s.n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    inv = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 0.0)
    lam, q = np.linalg.eigh(s.n * cov * np.outer(inv, inv))
    qb = q.T @ ((s.xy - np.outer(mu, s.sy)) * inv[:, None])
    w = np.einsum("pk,akt->apt", q, qb[None] / (np.maximum(lam, 0.0)[None, :, None] + alphas[:, None, None])) * inv[None, :, None]
    return w, my[None] - np.einsum("apt,p->at", w, mu)


def left_out_fits(sums: DataFrame, group: str, p: int, alphas: Sequence[float] = ALPHAS, inner: int = INNER_FOLDS) -> DataFrame:
    """For each group and outcome (``target``, by place): weights and intercept fitted on the other groups, the penalty, and
    the group's squared error with its n, sum and square of the outcome.

    The penalty is the one with the least error over the other groups, each left out in turn (nested). Up to ``inner`` groups
    are folds of their own; more are dealt into that many folds, so what is shared by all solves, the folds' sums, stays bounded. All
    fits come from sums less sums; with a single other group the first penalty is taken.
    """
    spark, a = sums.sparkSession, np.array(alphas, float)
    placed = ordered_scan(sums, [], [group], {"_no": row_no()}).withColumn("_f", F.pmod(F.col("_no") - 1, F.lit(inner)).cast("int"))
    rows = placed.select("_f", F.posexplode("v").alias("i", "x")).groupBy("_f", "i").agg(F.sum("x").alias("x")).collect()  # inner folds x sums
    width = 1 + max((r.i for r in rows), default=0)
    folds = np.zeros((inner, width))
    for r in rows:
        folds[r["_f"], r["i"]] = r["x"]
    shared = spark.sparkContext.broadcast(folds)
    kept = [sums.schema[group], *[T.StructField(n, t) for n, t in (("target", T.IntegerType()), ("weights", T.ArrayType(T.DoubleType())), *[(c, T.DoubleType()) for c in ("intercept", "alpha", "sse", "n_out", "y_sum", "y_sq")])]]

    def solve(batches):
        parts = shared.value
        total = parts.sum(0)
        for pdf in batches:
            out = []
            for g, v, f in zip(pdf[group], pdf["v"], pdf["_f"]):
                v = np.asarray(v, float)
                train = total - v
                own = _Sums(v, p)
                best = np.zeros(len(own.sy), int)
                errors = np.zeros((len(a), len(own.sy)))
                for i, part in enumerate(parts):
                    held = part - v if i == f else part
                    if held[0] > 0.5 and (train - held)[0] > 1.5:
                        errors += _Sums(held, p).errors(*_ridge(_Sums(train - held, p), a))
                if train[0] < 1.5:
                    continue
                best = errors.argmin(0)
                w, b = _ridge(_Sums(train, p), a)
                sse = own.errors(w, b)
                for t, k in enumerate(best.tolist()):
                    out.append((g, t, w[k, :, t].tolist(), float(b[k, t]), float(a[k]), float(sse[k, t]), float(own.n), float(own.sy[t]), float(own.yy[t])))
            yield pd.DataFrame(out, columns=[x.name for x in kept])

    return placed.select(group, "v", "_f").mapInPandas(solve, T.StructType(kept))


def r2_of_folds(w: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """R2 of the left-out predictions of all groups together, per outcome."""
    sst = F.sum("y_sq") - F.sum("y_sum") * F.sum("y_sum") / F.sum("n_out")
    return w.groupBy(*keys).agg(F.sum("n_out").cast("long").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.when(sst > 0, 1 - F.sum("sse") / sst).alias("r2"))


def logo_ridge(df: DataFrame, group: str, xs: Sequence[str], y: str, alphas: Sequence[float] = ALPHAS, inner: int = INNER_FOLDS) -> DataFrame:
    """Leave-one-group-out ridge predictions on the complete rows (column ``prediction``); scaling is fold local."""
    sums, means = group_sums(df, group, xs, [y])
    w = left_out_fits(sums, group, len(xs), alphas, inner)
    d = join_on(df.dropna(subset=[*xs, y]), w.select(group, "weights", "intercept"), [group], "inner")
    pred = sum((F.get("weights", F.lit(i)) * (F.col(x) - F.lit(float(means[i]))) for i, x in enumerate(xs)), F.col("intercept") + F.lit(float(means[-1])))
    return d.withColumn("prediction", pred).drop("weights", "intercept")


def regression_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """n, R2, mean absolute error and rank correlation of predictions, which are computed and stored once."""
    d = settle(df.select(F.lit(0).alias("_all"), F.col(y).cast("double").alias("_v0"), F.col(pred).cast("double").alias("_v1")))
    e = F.col("_v0") - F.col("_v1")
    a = d.agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop("_v0") * F.count("_v0"))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    rho = rank_correlations(d, ["_all"], ["_y", "_pred"], [("_y", "_pred")]).select("rho").scalar()
    return a.withColumn("rho", rho)


def permutation_test(df: DataFrame, group: str, xs: Sequence[str], y: str, row_id: str, n_perm: int = 200, seed: int = 1, alphas: Sequence[float] = ALPHAS,
                     inner: int = INNER_FOLDS, block_rows: int = PERMUTED_ROWS) -> DataFrame:
    """R2 of leave-one-group-out ridge, and the share of shuffled outcomes that reach it.

    Rows are dealt by a hash of their id into blocks of about ``block_rows``, and outcomes are shuffled inside the
    blocks: fewer rows are one block, more keep the test valid, since such shuffles form a group. A block
    gives the products of all its shuffles as one row of sums for each group, so no row is copied; every
    shuffle goes through the whole nested fit.
    """
    xs, p = list(xs), len(xs)
    d = df.dropna(subset=[*xs, y])
    facts = d.agg(F.count(F.lit(1)), *[F.avg(c) for c in [*xs, y]]).first()
    n, means = facts[0], np.array([v or 0.0 for v in facts[1:]])
    blocks = max(1, -(-n // block_rows))
    d = d.select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)], F.col(y).cast("double").alias("y"), F.xxhash64(row_id).alias("h"), F.col(row_id).cast("string").alias("id"))
    d = d.withColumn("block", F.pmod("h", F.lit(blocks)))
    out = T.StructType([T.StructField("g", d.schema["g"].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def sums(pdf):
        pdf = pdf.sort_values(["h", "id"])
        rng = np.random.default_rng([seed, int(pdf["block"].iloc[0])])
        x = pdf[[f"x{i}" for i in range(p)]].to_numpy() - means[:p]
        own = pdf["y"].to_numpy() - means[p]
        ys = np.stack([own, *[rng.permutation(own) for _ in range(n_perm)]], 1)
        code, names = pdf["g"].factorize(use_na_sentinel=False)
        rows = []
        for i in range(len(names)):
            a, b = x[code == i], ys[code == i]
            each = np.concatenate((b.sum(0)[:, None], b.T @ a, (b * b).sum(0)[:, None]), 1)
            rows.append(np.concatenate(([len(a)], a.sum(0), (a.T @ a).ravel(), each.ravel())).tolist())
        return pd.DataFrame({"g": names, "v": rows})

    parts = d.groupBy("block").applyInPandas(sums, out).select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    whole = settle(parts.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v")))
    r = r2_of_folds(left_out_fits(whole, "g", p, alphas, inner)).agg(
        F.max(F.when(F.col("target") == 0, F.col("r2"))).alias("r2"), F.collect_list(F.when(F.col("target") > 0, F.col("r2"))).alias("_null"))
    reached = F.size(F.filter("_null", lambda x: x >= F.col("r2")))
    return r.select("r2", F.lit(int(n_perm)).cast("long").alias("n_perm"), ((reached + 1) / (F.lit(int(n_perm)) + 1)).alias("p_value"))


def ablation_grid(df: DataFrame, group: str, sets: dict[str, Sequence[str]], targets: Sequence[str], alphas: Sequence[float] = ALPHAS, inner: int = INNER_FOLDS) -> DataFrame:
    """R2 of every feature set for every target, all targets of a set from one pass; best set per target marked."""
    parts = []
    names = F.array(*[F.lit(t) for t in targets])
    for name, cs in sets.items():
        sums, _ = group_sums(df.dropna(subset=[*dict.fromkeys(c for x in sets.values() for c in x)]), group, cs, targets)
        w = r2_of_folds(left_out_fits(sums, group, len(cs), alphas, inner))
        parts.append(w.select(F.lit(name).alias("feature_set"), F.get(names, F.col("target")).alias("target"), "n", "n_groups", "r2"))
    allr = settle(reduce(lambda a, b: a.unionByName(b), parts))
    best = allr.groupBy("target").agg(F.max_by("feature_set", F.struct("r2", "feature_set")).alias("_b"))
    return allr.join(best, "target").withColumn("best", F.col("feature_set") == F.col("_b")).drop("_b")


# ------------------------------------------------------------------ logistic over left-out groups


def logo_logistic(df: DataFrame, group: str, xs: Sequence[str], y: str, binarise: bool = True, penalty: float = 1.0, max_iter: int = 2000, tol: float = 1e-8) -> DataFrame:
    """Rows with ``label``, ``baseline_prediction``, ``model_prediction`` and ``model_score`` of the model that did not see
    the row's group.

    Features are standardised and their nulls filled with the mean of the training groups; classes weigh alike (balanced). Newton
    steps of all folds share one pass over the rows, which gives each fold's gradient and curvature summed over its
    training rows. A fold whose training labels are all alike predicts them, with a null score. With ``binarise`` the
    outcome is split at the median of the training groups, otherwise at a half. Rows without outcome or group are left out. The
    number of groups is that of the models, (p + 2)^2 numbers each in the driver.
    """
    xs, p = list(xs), len(xs)
    d = df.filter(F.col(y).isNotNull() & F.col(group).isNotNull())
    x = F.array(*[F.col(c).cast("double") for c in xs])
    lean = settle(d.select(F.col(group).alias("g"), x.alias("x"), F.col(y).cast("double").alias("y")))
    per = lean.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(p) for k, f in (("c", F.count), ("s", lambda c: F.sum(c)), ("q", lambda c: F.sum(c * c)))]).orderBy("g").collect()
    groups = [r["g"] for r in per]
    if not groups:
        return d.withColumns({"label": F.lit(None).cast("int"), "baseline_prediction": F.lit(None).cast("int"), "model_prediction": F.lit(None).cast("int"), "model_score": F.lit(None).cast("double")})
    c, s, q = (np.array([[r[f"{k}{i}"] or 0.0 for i in range(p)] for r in per], float).reshape(-1, p) for k in "csq")
    n = np.array([r["n"] for r in per], float)
    rest = lambda v: v.sum(0) - v
    seen = np.maximum(rest(c), 1.0)
    mu = rest(s) / seen
    sd = np.sqrt(np.maximum(rest(q) - seen * mu**2, 0.0) / np.maximum(rest(n), 1.0)[:, None])  # filled cells add nothing
    sd = np.where(sd > 1e-12, sd, 1.0)
    cut = np.full(len(groups), 0.5)
    if binarise:
        at = F.explode(F.array(*[F.lit(i) for i in range(len(groups))])).alias("fold")
        fold_of = F.create_map(*[v for i, g in enumerate(groups) for v in (F.lit(g), F.lit(i))])
        med = exact_percentiles(lean.select("y", fold_of[F.col("g")].alias("own"), at).filter("own != fold"), ["fold"], {"m": ("y", 0.5)})
        for r in med.collect():
            cut[r["fold"]] = r["m"]
    spark, place = df.sparkSession, {g: i for i, g in enumerate(groups)}
    over = (lambda v, t: v >= t) if binarise else (lambda v, t: v > t)

    def rows_of(batches):
        for b in batches:
            m = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float).reshape(-1, p)
            yield np.array([place[g] for g in b.column("g").to_pylist()]), m, np.asarray(b.column("y"), float)

    def summed(one, width):
        """Sum over all rows of ``one(fold, z, label)`` for each fold's training rows."""

        def run(batches):
            total = np.zeros((len(groups), width))
            for own, m, v in rows_of(batches):
                for f in range(len(groups)):
                    use = own != f
                    z = (m[use] - mu[f]) / sd[f]
                    total[f] += one(f, np.concatenate((np.ones((len(z), 1)), np.where(np.isnan(z), 0.0, z)), 1), over(v[use], cut[f]).astype(float))
            if total.any():
                i = np.flatnonzero(total.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()[i])], ["i", "v"])

        out = np.zeros(len(groups) * width)
        for r in lean.select("g", "x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out.reshape(len(groups), width)

    ones = summed(lambda f, z, label: np.array([len(label), label.sum()]), 2)
    count, pos = ones.T
    mixed = (pos > 0) & (pos < count)
    weight = np.stack((count / np.maximum(2 * (count - pos), 1), count / np.maximum(2 * pos, 1)), 1)
    beta, k = np.zeros((len(groups), p + 1)), p + 1
    ridge = np.diag([0.0] + [penalty] * p)

    def newton(f, z, label):
        if not mixed[f]:
            return np.zeros(k + k * k + 1)
        lin = z @ beta[f]
        prob = 1 / (1 + np.exp(-np.clip(lin, -700, 700)))
        w = np.where(label > 0, weight[f, 1], weight[f, 0])
        loss = (w * (np.logaddexp(0, lin) - label * lin)).sum()
        return np.concatenate((z.T @ (w * (prob - label)), ((z * (w * prob * (1 - prob))[:, None]).T @ z).ravel(), [loss]))

    step, before, base = np.zeros_like(beta), np.full(len(groups), np.inf), beta.copy()
    live = mixed.copy()
    for _ in range(max_iter):
        if not live.any():
            break
        got = summed(newton, k + k * k + 1)
        for f in np.flatnonzero(live):
            loss = got[f, -1] + 0.5 * penalty * (beta[f, 1:] ** 2).sum()
            if loss > before[f] + 1e-9 * abs(before[f]) and np.abs(step[f]).max() > tol:  # too far: half of the step
                step[f] /= 2
                beta[f] = base[f] - step[f]
                continue
            before[f], base[f] = loss, beta[f].copy()
            grad = got[f, :k] + ridge @ beta[f]
            step[f] = np.linalg.solve(got[f, k : k + k * k].reshape(k, k) + ridge + 1e-12 * np.eye(k), grad)
            beta[f] = base[f] - step[f]
            live[f] = np.abs(step[f]).max() > tol
    fits = spark.createDataFrame([(i, float(cut[i]), int(2 * pos[i] > count[i]), bool(mixed[i]), *[v.tolist() for v in (mu[i], sd[i], beta[i])]) for i in range(len(groups))],
                                 "_fold int, _cut double, baseline_prediction int, _mixed boolean, _mu array<double>, _sd array<double>, _b array<double>")
    names = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("_fold", T.IntegerType())]))
    j = join_on(d, names.join(fits, "_fold"), [group], "inner")
    z = F.zip_with(F.zip_with(x, F.col("_mu"), lambda a, b: a - b), F.col("_sd"), lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    lin = F.aggregate(F.zip_with(z, F.slice("_b", 2, p), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) + F.get("_b", F.lit(0))
    label = (F.col(y).cast("double") >= F.col("_cut") if binarise else F.col(y).cast("double") > F.col("_cut")).cast("int")
    score = F.when(F.col("_mixed"), 1 / (1 + F.exp(-lin)))
    out = j.withColumns({"label": label, "model_score": score})
    out = out.withColumn("model_prediction", F.coalesce((F.col("model_score") > 0.5).cast("int"), F.col("baseline_prediction")))
    return out.drop("_fold", "_cut", "_mixed", "_mu", "_sd", "_b")


def classifier_scores(pred: DataFrame) -> DataFrame:
    """metric, baseline and linear_model: accuracy, macro F1 and area under the ROC curve over all left-out rows together.

    The area is null when a row has no score, or one label is missing; the baseline has none.
    """
    counts = pred.agg(
        *[F.count_if((F.col("label") == a) & (F.col(c) == b)).cast("double").alias(f"{m}{a}{b}") for m, c in (("b", "baseline_prediction"), ("m", "model_prediction")) for a in (0, 1) for b in (0, 1)],
        F.count_if(F.col("model_score").isNull()).alias("gaps"))
    ranks = value_ranks(pred.select(F.lit(0).alias("_k"), "model_score"), ["_k"], "model_score").select(F.col("model_score").alias("_s"), "avg_rank")
    pos = pred.filter("label = 1").groupBy(F.col("model_score").alias("_s")).agg(F.count(F.lit(1)).alias("_w"))
    top = pos.join(ranks, "_s").agg(F.sum(F.col("avg_rank") * F.col("_w")).alias("r"))
    d = counts.withColumn("_r", top.select("r").scalar())

    def f1(m):
        each = lambda a: F.coalesce(F.try_divide(2 * F.col(f"{m}{a}{a}"), 2 * F.col(f"{m}{a}{a}") + F.col(f"{m}{a}{1 - a}") + F.col(f"{m}{1 - a}{a}")), F.lit(0.0))
        there = lambda a: F.when(F.col(f"{m}{a}{a}") + F.col(f"{m}{a}{1 - a}") + F.col(f"{m}{1 - a}{a}") > 0, 1.0).otherwise(0.0)
        return F.try_divide(each(0) + each(1), there(0) + there(1))

    acc = lambda m: F.try_divide(F.col(f"{m}00") + F.col(f"{m}11"), F.col(f"{m}00") + F.col(f"{m}01") + F.col(f"{m}10") + F.col(f"{m}11"))
    n1, n0 = F.col("m10") + F.col("m11"), F.col("m00") + F.col("m01")
    auc = F.when(F.col("gaps") == 0, F.try_divide(F.col("_r") - n1 * (n1 + 1) / 2, n1 * n0))
    row = lambda name, a, b: F.struct(F.lit(name).alias("metric"), a.alias("baseline"), b.alias("linear_model"))
    return d.select(F.inline(F.array(row("accuracy", acc("b"), acc("m")), row("macro_f1", f1("b"), f1("m")), row("roc_auc", F.lit(None).cast("double"), auc))))


def knn_impute(df: DataFrame, reference: DataFrame, cols: Sequence[str], k: int = 5, block_rows: int = 20_000) -> DataFrame:
    """Fill nulls with the distance-weighted mean of the k nearest reference rows (training rows only).

    Distance is Euclidean over the columns both rows have, scaled up for the missing ones; a row at distance
    zero alone counts. Rows with gaps and reference rows are dealt into blocks, and a task compares one
    block of each and keeps the k nearest per gap, so neither side has a limit. Without a neighbour the
    reference mean is taken; a column that is empty in the reference becomes 0. Rows need no key.
    """
    cols = list(cols)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    d = df.withColumn("_v", values).withColumn("_gap", F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    holes = d.filter("_gap").select("_v").distinct()
    ref = reference.select(values.alias("_v"))
    n_ref = max(1, -(-ref.count() // block_rows))
    n_hole = max(1, -(-holes.count() // block_rows))
    dealt = lambda side, n, other, on, off: side.select(
        "_v", F.lit(on == "_b").alias("_ref"), F.pmod(F.xxhash64("_v"), F.lit(n)).alias(on), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(off))
    both = dealt(holes, n_hole, n_ref, "_a", "_b").unionByName(dealt(ref, n_ref, n_hole, "_b", "_a"))

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        as_array = lambda rows: np.array([[np.nan if x is None else x for x in v] for v in rows], dtype=float).reshape(-1, len(cols))
        rows, base = list(part.loc[~part["_ref"], "_v"]), as_array(part.loc[part["_ref"], "_v"])
        out = []
        for row, v in zip(rows, as_array(rows), strict=True):
            gap = np.isnan(v)
            seen = ~gap[None, :] & ~np.isnan(base)
            diff = np.where(seen, base - np.where(gap, 0.0, v)[None, :], 0.0)
            n = seen.sum(1)
            dist = np.where(n > 0, np.sqrt((diff**2).sum(1) * len(v) / np.maximum(n, 1)), np.inf)
            for j in np.flatnonzero(gap):
                ok = np.flatnonzero(np.isfinite(dist) & ~np.isnan(base[:, j]))
                out += [(row, int(j), float(dist[i]), float(base[i, j])) for i in ok[np.lexsort((base[ok, j], dist[ok]))[:k]]]
        return pd.DataFrame(out, columns=["_v", "j", "dist", "x"])

    near = both.groupBy("_a", "_b").applyInPandas(nearest, "_v array<double>, j int, dist double, x double")
    best = near.groupBy("_v", "j").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "x"))), 1, k).alias("s"))  # k rows of each block
    exact = F.filter("s", lambda p: p["dist"] == 0)
    used = F.when(F.size(exact) > 0, F.transform(exact, lambda p: F.struct(F.lit(1.0).alias("w"), p["x"].alias("x")))).otherwise(F.transform("s", lambda p: F.struct((1 / p["dist"]).alias("w"), p["x"].alias("x"))))
    total = lambda f: F.aggregate("u", F.lit(0.0), lambda acc, p: acc + f(p))
    filled = best.withColumn("u", used).select("_v", "j", (total(lambda p: p["w"] * p["x"]) / total(lambda p: p["w"])).alias("fill"))
    fills = filled.groupBy("_v").agg(*[F.max(F.when(F.col("j") == i, F.col("fill"))).alias(f"_f{i}") for i in range(len(cols))])
    mean = reference.agg(*[F.coalesce(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))), F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    out = d.join(fills.withColumnRenamed("_v", "_w"), F.col("_gap") & (F.col("_v") == F.col("_w")), "left")
    return out.withColumns({c: F.coalesce(known(c), F.col(f"_f{i}"), F.lit(float(mean[i]))) for i, c in enumerate(cols)}).select(*df.columns)
