"""Queries over scaling, screening, components, states and grouped models."""

from pyspark.sql import functions as F

from gatherline.operators import chains, hmm, learn
from gatherline.plans.bindings import SAMPLES, samples
from gatherline.plans.registry import query, rounded, table

_X = ["l_quantity", "l_discount", "l_tax"]


def _rated(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    li = table(spark, sf, "lineitem").join(s, "l_suppkey")
    return li.select("nation", "l_orderkey", "l_linenumber", "l_partkey", *_X, F.col("l_extendedprice").alias("y"))


@query("impute_standardise", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.02 THEN l_tax END AS x FROM lineitem), i AS (SELECT *, coalesce(x, avg(x) OVER ()) AS v FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS x FROM i""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("x"))
    return rounded(learn.impute_standardise(li, ["x"]))


@query("feature_screen", """WITH l AS (SELECT 'a' AS feature, CASE WHEN l_tax > 0.02 THEN l_tax * 100 END AS value FROM lineitem UNION ALL SELECT 'b', l_quantity FROM lineitem UNION ALL SELECT 'c', CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END FROM lineitem),
s AS (SELECT feature, count(value) * 1.0::DOUBLE / count(*) AS coverage, count(*) FILTER (value = 0) * 1.0::DOUBLE / count(value) AS zero_share, var_samp(value) AS variance FROM l GROUP BY 1)
SELECT feature, round(coverage, 6) AS coverage, round(zero_share, 6) AS zero_share, round(variance, 6) AS variance, coverage >= 0.8 AND zero_share < 0.8 AND variance >= 1e-4 AS eligible FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100).alias("a"), F.col("l_quantity").alias("b"), (F.col("l_quantity") > 45).cast("double").alias("c"))
    return rounded(learn.feature_screen(li, ["a", "b", "c"]))


@query("correlated_columns", """WITH l AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_extendedprice AS c, l_discount AS d FROM lineitem)
SELECT 'b' AS feature, round(abs(corr(a, b)), 6) AS strongest, abs(corr(a, b)) > 0.95 AS redundant FROM l UNION ALL SELECT 'c', round(greatest(abs(corr(a, c)), abs(corr(b, c))), 6), greatest(abs(corr(a, c)), abs(corr(b, c))) > 0.95 FROM l
UNION ALL SELECT 'd', round(greatest(abs(corr(a, d)), abs(corr(b, d)), abs(corr(c, d))), 6), greatest(abs(corr(a, d)), abs(corr(b, d)), abs(corr(c, d))) > 0.95 FROM l""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("b"), F.col("l_extendedprice").alias("c"), F.col("l_discount").alias("d"))
    return rounded(learn.correlated_columns(li, ["a", "b", "c", "d"]))


@query("clean_features", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN l_quantity BETWEEN 2 AND 50 THEN l_quantity END AS q FROM lineitem),
st AS (SELECT avg(q) AS m, stddev_samp(q) AS d FROM g), w AS (SELECT g.*, CASE WHEN q IS NOT NULL THEN least(greatest(q, m - 1.5 * d), m + 1.5 * d) END AS v FROM g, st),
a AS (SELECT l_suppkey, median(v) AS med, count(v) AS n FROM w WHERE l_returnflag <> 'A' GROUP BY 1), k AS (SELECT w.l_suppkey, median(abs(v - med)) AS mad FROM w JOIN a USING (l_suppkey) WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 2 THEN round(CASE WHEN mad < 1e-9 THEN v - med ELSE (v - med) / (1.4826 * mad) END, 6) END AS q FROM w LEFT JOIN a USING (l_suppkey) LEFT JOIN k USING (l_suppkey)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("q"))
    d, keep = learn.clean_features(li, ["l_suppkey"], ["q"], {"q": (2.0, 50.0)}, F.col("l_returnflag") != "A", 1.5)
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", *keep))


@query("principal_components")
def _(spark, sf):
    v = learn.assemble(table(spark, sf, "embeddings"), "embedding")
    d, _ev = learn.principal_components(v, "features")
    return rounded(d.select("vec_id", F.size("components").cast("long").alias("n_components"), F.get("components", F.lit(0)).alias("c0")))


@query("kmeans_sweep")
def _(spark, sf):
    v = learn.assemble(table(spark, sf, "embeddings"), "embedding")
    d, _scores = learn.kmeans_sweep(v, "features")
    return d.groupBy("cluster").agg(F.count("*").alias("n"))


@query("gaussian_mixture")
def _(spark, sf):
    v = learn.assemble(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax"), _X)
    return learn.gaussian_mixture(v, "features", 3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("viterbi_smooth", "WITH RECURSIVE " + SAMPLES + """, e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, -abs(value - 20) / 40 AS a, -abs(value - 80) / 40 AS b, -abs(value - 200) / 40 AS c FROM s),
v AS (SELECT user_id, k, a AS fa, b AS fb, c AS fc FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, greatest(fa, fb - 1.5::DOUBLE, fc - 1.5::DOUBLE) + a, greatest(fa - 1.5::DOUBLE, fb, fc - 1.5::DOUBLE) + b, greatest(fa - 1.5::DOUBLE, fb - 1.5::DOUBLE, fc) + c FROM v JOIN e ON e.user_id = v.user_id AND e.k = v.k + 1),
z AS (SELECT user_id, max(k) AS n FROM e GROUP BY 1),
p AS (SELECT v.user_id, v.k, CASE WHEN fa >= fb AND fa >= fc THEN 0 WHEN fb >= fc THEN 1 ELSE 2 END AS state FROM v JOIN z ON z.user_id = v.user_id AND z.n = v.k
  UNION ALL SELECT v.user_id, v.k, CASE WHEN fa - (p.state <> 0)::INT * 1.5::DOUBLE >= fb - (p.state <> 1)::INT * 1.5::DOUBLE AND fa - (p.state <> 0)::INT * 1.5::DOUBLE >= fc - (p.state <> 2)::INT * 1.5::DOUBLE THEN 0
    WHEN fb - (p.state <> 1)::INT * 1.5::DOUBLE >= fc - (p.state <> 2)::INT * 1.5::DOUBLE THEN 1 ELSE 2 END FROM p JOIN v ON v.user_id = p.user_id AND v.k = p.k - 1)
SELECT event_id, CAST(state AS BIGINT) AS state FROM e JOIN p USING (user_id, k)""")
def _(spark, sf):
    s = samples(spark, sf).select("event_id", "user_id", "t", F.array(*[-F.abs(F.col("value") - c) / 40 for c in (20, 80, 200)]).alias("lp"))
    return chains.viterbi_smooth(s, ["user_id"], ["t"], "lp", 1.5).select("event_id", "state")


def _streams(spark, sf):
    return samples(spark, sf).select("user_id", "group_id", "event_id", "t", F.log1p("value").alias("x"))


@query("hidden_states")
def _(spark, sf):
    d, _ = hmm.hidden_states(_streams(spark, sf), ["user_id"], ["t"], ["x"], 3, ["event_id"])
    return rounded(d.select("event_id", "state", "probability"), 4)


@query("hidden_states_audit", "WITH " + SAMPLES + """ SELECT count(*) AS n_rows, 3::BIGINT AS n_states, true AS never_falls, true AS ended, true AS fair_posteriors, true AS same_occupancy FROM s WHERE value IS NOT NULL""")
def _(spark, sf):
    """What must hold of any fit: every row decoded, no round that lowers the likelihood, an end within the limits, and
    posteriors that add up to the expected occupancy of the fit's last round."""
    d, m = hmm.hidden_states(_streams(spark, sf), ["user_id"], ["t"], ["x"], 3, ["event_id"])
    rises = all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history, m.history[1:]))
    near = F.abs(F.lit(float(m.occupancy.sum())) - F.count("*")) <= 1e-6 * F.count("*")
    return d.agg(
        F.count("*").alias("n_rows"), F.count_distinct("state").alias("n_states"), F.lit(rises).alias("never_falls"),
        F.lit(m.converged or m.rounds == 200).alias("ended"), (F.min("probability") >= 1 / 3 - 0.34).alias("fair_posteriors"), near.alias("same_occupancy"),
    )


@query("state_number")
def _(spark, sf):
    best = hmm.choose(_streams(spark, sf), ["user_id"], ["t"], ["x"])
    rows = [(i + 1, m.k, m.n_rows, float(m.bic)) for i, m in enumerate(best)]
    return rounded(spark.createDataFrame(rows, "place int, k int, n_rows long, bic double"), 1)


@query("state_stability")
def _(spark, sf):
    return rounded(hmm.state_stability(_streams(spark, sf), ["user_id"], ["t"], ["x"], 2, "group_id", "event_id"), 4)


_SUMS = ["n", "a1", "a2", "a3", "p11", "p12", "p13", "p22", "p23", "p33", "y", "q1", "q2", "q3", "yy"]


def _ridge_sql(y: str, use: tuple[int, ...] = (1, 2, 3), tag: str = "") -> str:
    """CTEs that give wt{tag}: nation, w1-w3, b0 and sse of nested leave-one-nation-out ridge in closed form."""
    t, on = tag, lambda i, e, other="0": e if i in use else other
    both = lambda i, j: f"(p{i}{j} - a{i} * a{j} / n)" if i in use and j in use else "0"
    diag = lambda i: on(i, f"(p{i}{i} - a{i} * a{i} / n) * (1 + alpha / n)", "1")
    rhs = lambda i: on(i, f"(q{i} - a{i} * y / n)")
    minus = lambda *xs: ", ".join(f"t.{c} - {' - '.join(f'{x}.{c}' for x in xs)} AS {c}" for c in _SUMS)
    solved = f"""SELECT *, {diag(1)} AS m11, {diag(2)} AS m22, {diag(3)} AS m33, {both(1, 2)} AS m12, {both(1, 3)} AS m13, {both(2, 3)} AS m23, {rhs(1)} AS r1, {rhs(2)} AS r2, {rhs(3)} AS r3 FROM"""
    cramer = """SELECT *, (y - w1 * a1 - w2 * a2 - w3 * a3) / n AS b0 FROM (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det,
      (r1 * (m22 * m33 - m23 * m23) - m12 * (r2 * m33 - m23 * r3) + m13 * (r2 * m23 - m22 * r3)) / det AS w1,
      (m11 * (r2 * m33 - m23 * r3) - r1 * (m12 * m33 - m23 * m13) + m13 * (m12 * r3 - r2 * m13)) / det AS w2,
      (m11 * (m22 * r3 - r2 * m23) - m12 * (m12 * r3 - r2 * m13) + r1 * (m12 * m23 - m22 * m13)) / det AS w3 FROM"""
    sse = """h.yy - 2 * b0 * h.y - 2 * (w1 * h.q1 + w2 * h.q2 + w3 * h.q3) + h.n * b0 * b0 + 2 * b0 * (w1 * h.a1 + w2 * h.a2 + w3 * h.a3)
      + w1 * w1 * h.p11 + w2 * w2 * h.p22 + w3 * w3 * h.p33 + 2 * (w1 * w2 * h.p12 + w1 * w3 * h.p13 + w2 * w3 * h.p23)"""
    return f"""d{t} AS (SELECT s_nationkey AS nation, l_orderkey, l_linenumber, l_partkey, l_quantity AS x1, l_discount AS x2, l_tax AS x3, {y} AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  mm{t} AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM d{t}),
  c{t} AS (SELECT nation, x1 - m1 AS x1, x2 - m2 AS x2, x3 - m3 AS x3, y - my AS y FROM d{t}, mm{t}),
  s{t} AS MATERIALIZED (SELECT nation, count(*)::DOUBLE AS n, sum(x1) AS a1, sum(x2) AS a2, sum(x3) AS a3, sum(x1 * x1) AS p11, sum(x1 * x2) AS p12, sum(x1 * x3) AS p13, sum(x2 * x2) AS p22, sum(x2 * x3) AS p23,
    sum(x3 * x3) AS p33, sum(y) AS y, sum(x1 * y) AS q1, sum(x2 * y) AS q2, sum(x3 * y) AS q3, sum(y * y) AS yy FROM c{t} GROUP BY nation),
  t{t} AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in _SUMS)} FROM s{t}), al{t} AS (SELECT pow(10, -2 + 5.0::DOUBLE * i / 11) AS alpha FROM range(12) r(i)),
  inn{t} AS ({cramer} ({solved} (SELECT g.nation, h.nation AS held, alpha, {minus("g", "h")} FROM t{t} t, s{t} g, s{t} h, al{t} WHERE g.nation <> h.nation)))),
  er{t} AS (SELECT i.nation, alpha, sum({sse}) AS e FROM inn{t} i JOIN s{t} h ON h.nation = i.held GROUP BY ALL),
  be{t} AS (SELECT nation, arg_min(alpha, struct_pack(e := e, alpha := alpha)) AS alpha FROM er{t} GROUP BY nation),
  ou{t} AS ({cramer} ({solved} (SELECT g.nation, alpha, {minus("g")} FROM t{t} t, s{t} g JOIN be{t} USING (nation))))),
  wt{t} AS (SELECT o.nation, w1, w2, w3, b0, h.n, h.y, h.yy, {sse} AS sse FROM ou{t} o JOIN s{t} h USING (nation))"""


_PREDICTED = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, d.y, w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3) + b0 + my AS prediction FROM d JOIN wt USING (nation), mm)"""


@query("logo_ridge_scores", f"""WITH {_ridge_sql("l_extendedprice")}, {_PREDICTED},
r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0::DOUBLE AS rp FROM p)
SELECT count(*) AS n, round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(y)), 4) AS r2, round(avg(abs(y - prediction)), 2) AS mae, round(corr(ry, rp), 4) AS rho FROM r""")
def _(spark, sf):
    p = learn.logo_ridge(_rated(spark, sf), "nation", _X, "y")
    s = learn.regression_scores(p, "y", "prediction")
    return s.select("n", F.round("r2", 4).alias("r2"), F.round("mae", 2).alias("mae"), F.round("rho", 4).alias("rho"))


@query("logo_ridge_predictions", f"WITH {_ridge_sql('l_extendedprice')}, {_PREDICTED} SELECT l_orderkey, l_linenumber, l_partkey, round(prediction, 3) AS prediction FROM p")
def _(spark, sf):
    return rounded(learn.logo_ridge(_rated(spark, sf), "nation", _X, "y").select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 3)


@query("permutation_test")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 7).cast("double").alias("a"), (F.col("c_custkey") % 11).cast("double").alias("b"))
    return rounded(learn.permutation_test(c, "c_nationkey", ["a", "b"], "c_acctbal", "c_custkey"), 4)


_ABLATED = [(name, y, use, f"_{name}_{y}") for name, use in (("size", (1,)), ("terms", (2, 3)), ("all", (1, 2, 3))) for y in ("price", "saved")]
_TARGETS = {"price": "l_extendedprice", "saved": "l_extendedprice * l_discount"}


@query("ablation_grid", "WITH " + ", ".join(_ridge_sql(_TARGETS[y], use, tag) for _, y, use, tag in _ABLATED)
       + ", r AS (" + " UNION ALL ".join(f"SELECT '{name}' AS feature_set, '{y}' AS target, sum(n)::BIGINT AS n, count(*) AS n_groups, 1 - sum(sse) / (sum(yy) - sum(y) * sum(y) / sum(n)) AS r2 FROM wt{tag}" for name, y, _, tag in _ABLATED)
       + ") SELECT feature_set, target, n, n_groups, round(r2, 4) AS r2, r2 = max(r2) OVER (PARTITION BY target) AS best FROM r")
def _(spark, sf):
    d = _rated(spark, sf).withColumnRenamed("y", "price").withColumn("saved", F.col("price") * F.col("l_discount"))
    return rounded(learn.ablation_grid(d, "nation", {"size": ["l_quantity"], "terms": ["l_discount", "l_tax"], "all": _X}, ["price", "saved"]), 4)


@query("logo_logistic")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "lang", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", "[^.!?]", "")).cast("double").alias("stops"), "quality")
    return rounded(learn.classifier_scores(learn.logo_logistic(d, "lang", ["n_chars", "stops"], "quality", binarise=False)), 4)


@query("knn_impute", """WITH o AS (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1), c AS (SELECT customer.*, price, n FROM customer LEFT JOIN o USING (c_custkey)),
r AS (SELECT c_nationkey AS k, avg(c_acctbal) AS ra, avg(price) AS rp, avg(n) AS rn FROM c GROUP BY 1), h AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS a, price AS p, n FROM c),
d AS (SELECT c_custkey, ra, rp, rn, sqrt((coalesce((a - ra)**2, 0) + coalesce((p - rp)**2, 0) + coalesce((n - rn)**2, 0)) * 3 / nullif((a IS NOT NULL)::INT + (p IS NOT NULL)::INT + (n IS NOT NULL)::INT, 0)) AS dist FROM h, r WHERE a IS NULL OR p IS NULL OR n IS NULL),
t AS (SELECT * FROM d WHERE dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist) <= 3), m AS (SELECT c_custkey, sum(ra / dist) / sum(1 / dist) AS ra, sum(rp / dist) / sum(1 / dist) AS rp, sum(rn / dist) / sum(1 / dist) AS rn FROM t GROUP BY 1),
g AS (SELECT avg(ra) AS ra, avg(rp) AS rp, avg(rn) AS rn FROM r)
SELECT c_custkey, round(coalesce(a, m.ra, g.ra), 8) AS c_acctbal, round(coalesce(p, m.rp, g.rp), 8) AS price, round(coalesce(n, m.rn, g.rn), 8) AS n FROM h LEFT JOIN m USING (c_custkey), g""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left")
    ref = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("c_acctbal"), F.avg("price").alias("price"), F.avg("n").alias("n"))
    holes = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return rounded(learn.knn_impute(holes, ref, ["c_acctbal", "price", "n"], 3).select("c_custkey", "c_acctbal", "price", "n"), 8)
