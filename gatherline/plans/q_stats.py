"""Queries over statistics and audits."""

from pyspark.sql import functions as F

from gatherline.functions import exprs as X
from gatherline.operators import groups, joins, sampling, stats
from gatherline.plans.bindings import SAMPLES, samples
from gatherline.plans.registry import query, rounded, table

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, {c} AS value FROM lineitem" for c in _NUM)
_TASKS = ["T0", "T1", "T2", "T3", "T4"]


@query("response_quality", """SELECT o_custkey, count(*) AS n_responses, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'F') > 0 AS "has_F", count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS "items_F",
  count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'O') > 0 AS "has_O", count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS "items_O",
  round(least(count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') / 4.0::DOUBLE, 1) * 100, 6) AS "complete_pct_F", round(least(count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') / 3.0::DOUBLE, 1) * 100, 6) AS "complete_pct_O",
  count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') >= 4 AND count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') >= 3 AS complete FROM orders GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.response_quality(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"], "o_orderpriority", {"F": 4, "O": 3}))


@query("describe", f"""WITH l AS ({_LONG}), d AS (SELECT l_returnflag, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM l GROUP BY 1, 2)
SELECT l_returnflag, feature, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(sd / sqrt(n), 6) AS sem, round(mean - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 6) AS ci_high, round(mean / sd, 6) AS dz FROM d""")
def _(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), ["l_returnflag"], _NUM))


@query("feature_inventory", f"""WITH l AS (SELECT feature, CASE WHEN feature = 'l_tax' AND value > 0.07 THEN NULL ELSE value END AS value FROM ({_LONG}))
SELECT feature, count(value) AS n, round(count(value) * 100.0::DOUBLE / count(*), 8) AS coverage_pct, round(count(*) FILTER (value = 0) * 100.0::DOUBLE / count(value), 8) AS zero_pct, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, min(value) AS min, max(value) AS max,
  round(skewness(value), 8) AS skew, count(DISTINCT value) AS n_unique, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr FROM l GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") <= 0.07, F.col("l_tax")))
    return rounded(stats.feature_inventory(li, _NUM), 8)


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]


@query("pearson_table", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem GROUP BY 1" for a, b in _PAIRS))
def _(spark, sf):
    return rounded(stats.pearson_table(table(spark, sf, "lineitem"), ["l_returnflag"], _PAIRS))


@query("spearman_table", "WITH r AS (SELECT l_returnflag, " + ", ".join(f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0::DOUBLE AS {c}" for c in _NUM) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS rho FROM r GROUP BY 1" for a, b in _PAIRS))
def _(spark, sf):
    return rounded(stats.spearman_table(table(spark, sf, "lineitem"), ["l_returnflag"], _PAIRS))


def _t_p(t: str, nu: str) -> str:
    """Two-sided p of t in SQL: the density, integrated over the angle whose tangent is t / sqrt(nu)."""
    angle = f"atan(abs({t}) / sqrt({nu}))"
    area = f"list_sum(list_transform(range(2000), lambda i: pow(cos({angle} * (i + 0.5::DOUBLE) / 2000), {nu} - 1))) * {angle} / 2000"
    return f"(1 - 2 * exp(lgamma(({nu} + 1) / 2.0::DOUBLE) - lgamma({nu} / 2.0::DOUBLE)) / sqrt(pi()) * {area})"


@query("spearman_tests", "WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS x, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 97) - 1) / 2.0::DOUBLE AS y FROM customer), "
       "c AS (SELECT c_nationkey, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT *, CASE WHEN n >= 3 THEN " + _t_p("(rho * sqrt((n - 2) / (1 - rho * rho)))", "(n - 2)") + " END AS p FROM c), o AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, c_nationkey) AS k FROM p) "
       "SELECT c_nationkey, n, round(rho, 6) AS rho, round(p, 5) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END, 5) AS q FROM o")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 97).cast("double").alias("b"))
    r = stats.spearman_table(c, ["c_nationkey"], [("c_acctbal", "b")]).drop("a", "b").filter("n >= 3")
    return rounded(stats.with_p_and_q(r, "rho", ["c_nationkey"]).withColumns({x: F.round(x, 5) for x in ("p", "q")}))


@query("pair_catalogue", "SELECT 'l_quantity' AS a, 'l_tax' AS b, count(*) FILTER (l_tax > 0.02) AS n_complete, count(*) FILTER (l_tax > 0.02) >= 50000 AS enough FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), count(*) >= 50000 FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    return stats.pair_catalogue(li, ["l_quantity"], ["l_tax", "l_discount"], 50000)


@query("person_mean_correlation", """WITH p AS (SELECT o_custkey, avg(o_totalprice) AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1), j AS (SELECT m, n, c_acctbal AS b FROM p JOIN customer ON o_custkey = c_custkey)
SELECT 'b' AS a, 'm' AS b, count(*) AS n, round(corr(b, m), 6) AS r FROM j UNION ALL SELECT 'b', 'n', count(*), round(corr(b, n), 6) FROM j""")
def _(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.count("*").cast("double").alias("n"))
    j = p.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("b")), "o_custkey")
    return rounded(stats.pearson_table(j, [], [("b", "m"), ("b", "n")]))


@query("eta_squared", """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), t AS (SELECT avg(o_totalprice) AS mm, var_pop(o_totalprice) AS v, count(*) AS c FROM orders)
SELECT CAST(max(c) AS BIGINT) AS n, round(sum(n * (m - mm)**2) / (max(c) * max(v)), 8) AS eta_squared FROM g, t""")
def _(spark, sf):
    return rounded(stats.eta_squared(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 8)


@query("cronbach_alpha", """SELECT l_returnflag, count(*) AS n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha, round(2 * (1 - (var_samp(b) + var_samp(c)) / var_samp(b + c)), 6) AS alpha_without_a,
  round(2 * (1 - (var_samp(a) + var_samp(c)) / var_samp(a + c)), 6) AS alpha_without_b, round(2 * (1 - (var_samp(a) + var_samp(b)) / var_samp(a + b)), 6) AS alpha_without_c
FROM (SELECT l_returnflag, l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("c"))
    return rounded(stats.cronbach(li, ["l_returnflag"], ["a", "b", "c"]))


@query("label_agreement", """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), pe AS (SELECT sum(x.s * y.s) / max(t)**2 AS e FROM (SELECT a, sum(n) AS s FROM c GROUP BY 1) x JOIN (SELECT b, sum(n) AS s FROM c GROUP BY 1) y ON x.a = y.b, t),
m AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same, coalesce(sum(n) FILTER (a = 1 AND b = 1), 0) AS tp, coalesce(sum(n) FILTER (a <> 1 AND b = 1), 0) AS fp, coalesce(sum(n) FILTER (a = 1 AND b <> 1), 0) AS fn FROM c)
SELECT n::BIGINT AS n, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(same / n, 6) AS accuracy, round((same / n - e) / (1 - e), 6) AS kappa, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m, pe""")
def _(spark, sf):
    return rounded(stats.agreement(table(spark, sf, "labels"), "quality", "toxic", 1))


@query("contingency_table", """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS r, sum(n) OVER (PARTITION BY o_orderpriority) * sum(n) OVER (PARTITION BY o_orderstatus) / sum(n) OVER () AS x FROM c)
SELECT o_orderstatus, o_orderpriority, n, round(n / r, 6) AS row_share, round(x, 6) AS expected, round((n - x)**2 / x, 6) AS chi2_term FROM e""")
def _(spark, sf):
    return rounded(stats.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("chi_square", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c)
SELECT sum(n)::BIGINT AS n, round(sum((n - x)**2 / x), 5) AS chi2, CAST(8 AS BIGINT) AS df, round(exp(-sum((n - x)**2 / x) / 2) * (1 + sum((n - x)**2 / x) / 2 + (sum((n - x)**2 / x) / 2)**2 / 2 + (sum((n - x)**2 / x) / 2)**3 / 6), 6) AS p, round(sqrt(sum((n - x)**2 / x) / (sum(n) * 2)), 6) AS cramer_v FROM e""")
def _(spark, sf):
    c = stats.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(c.withColumn("chi2", F.round("chi2", 5)))


_P = """(1 / (1 + 0.3275911 * (abs(z) / sqrt(2)))) * (0.254829592 + (1 / (1 + 0.3275911 * (abs(z) / sqrt(2)))) * (-0.284496736 + (1 / (1 + 0.3275911 * (abs(z) / sqrt(2)))) * (1.421413741 + (1 / (1 + 0.3275911 * (abs(z) / sqrt(2)))) * (-1.453152027 + (1 / (1 + 0.3275911 * (abs(z) / sqrt(2)))) * 1.061405429)))) * exp(-z * z / 2)"""
_P = _P.replace("0.3275911", "0.3275911::DOUBLE")


_SIGNS = """signs(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda i: coalesce(CASE WHEN i < len(c) THEN c[i + 1] END, 0) + coalesce(CASE WHEN i - n >= 1 THEN c[i - n] END, 0)) FROM signs WHERE n < 50)"""
_BH = "CASE WHEN {p} IS NOT NULL THEN least(1, min({p} * m{p} / r{p}) OVER (ORDER BY r{p} DESC ROWS UNBOUNDED PRECEDING)) END"


@query("paired_contrasts", "WITH RECURSIVE " + SAMPLES + ", " + _SIGNS + """, w AS (SELECT user_id, task_id, avg(value) AS v FROM s GROUP BY 1, 2),
p AS (SELECT a.task_id AS task_a, b.task_id AS task_b, a.v AS x, b.v AS y, b.v - a.v AS d FROM w a JOIN w b ON a.user_id = b.user_id AND a.task_id < b.task_id),
r AS (SELECT *, rank() OVER k + (count(*) OVER (PARTITION BY task_a, task_b, round(abs(d), 9)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY task_a, task_b, round(abs(d), 9)) AS tc FROM p WHERE d <> 0 WINDOW k AS (PARTITION BY task_a, task_b ORDER BY round(abs(d), 9))),
q AS (SELECT task_a, task_b, count(*) AS m, sum(rk) FILTER (d > 0) AS wp, sum(tc * tc - 1) AS tie FROM r GROUP BY 1, 2),
b AS (SELECT task_a, task_b, count(*) AS n, avg(x) AS ma, avg(y) AS mb, avg(d) AS md, stddev_samp(d) AS sd FROM p GROUP BY 1, 2),
z AS (SELECT b.*, m, tie, least(wp, m * (m + 1) / 2 - wp) AS w, (least(wp, m * (m + 1) / 2 - wp) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - tie / 48.0::DOUBLE) AS z FROM b JOIN q USING (task_a, task_b)),
e AS (SELECT z.*, CASE WHEN tie = 0 AND m = z.n AND z.n <= 50 THEN least(1, 2 * list_sum(c[1:w::BIGINT + 1]) / pow(2, m)) ELSE """ + _P + " END AS pw, " + _t_p("(md / (sd / sqrt(z.n)))", "(z.n - 1)") + """ AS pt FROM z LEFT JOIN signs ON signs.n = m),
o AS (SELECT *, count(pw) OVER () AS mpw, count(pt) OVER () AS mpt, row_number() OVER (ORDER BY pw, task_a, task_b) AS rpw, row_number() OVER (ORDER BY pt, task_a, task_b) AS rpt FROM e)
SELECT task_a, task_b, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(md, 6) AS mean_diff, round(w, 1) AS w, round(z, 6) AS z, round(md / (sd / sqrt(n)), 6) AS t, round(md / sd, 6) AS dz, round(pw, 6) AS p_wilcoxon, round(pt, 5) AS p_t,
  round(""" + _BH.format(p="pw") + ", 5) AS q_wilcoxon, round(" + _BH.format(p="pt") + """, 5) AS q_t FROM o""")
def _(spark, sf):
    w = samples(spark, sf).groupBy("user_id", "task_id").agg(F.avg("value").alias("v"))
    return rounded(stats.paired_contrasts(w, ["user_id"], "task_id", "v", _TASKS).withColumns({c: F.round(c, 5) for c in ("p_t", "q_t", "q_wilcoxon")}))


@query("correlation_tests", "WITH c AS (SELECT c_nationkey, count(*) AS n, corr(c_acctbal, c_custkey) AS r FROM customer GROUP BY 1), p AS (SELECT *, " + _t_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)") + """ AS p FROM c),
k AS (SELECT *, p * (count(*) OVER ()) / row_number() OVER (ORDER BY p, c_nationkey) AS raw FROM p)
SELECT c_nationkey, n, round(r, 6) AS r, round(p, 5) AS p, round(least(1, min(raw) OVER (ORDER BY p, c_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS q FROM k""")
def _(spark, sf):
    c = stats.pearson_table(table(spark, sf, "customer"), ["c_nationkey"], [("c_acctbal", "c_custkey")]).drop("a", "b")
    return rounded(stats.with_p_and_q(c, "r", ["c_nationkey"]).withColumns({"p": F.round("p", 5), "q": F.round("q", 5)}))


_RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY k, v) AS tc FROM d),
g AS (SELECT k, sum(rk) FILTER (g = 'a') AS ra, count(*) FILTER (g = 'a') AS na, count(*) FILTER (g = 'b') AS nb, sum(tc::DOUBLE * tc - 1) AS tie, avg(v) FILTER (g = 'a') AS ma, avg(v) FILTER (g = 'b') AS mb, var_samp(v) FILTER (g = 'a') AS va, var_samp(v) FILTER (g = 'b') AS vb FROM r GROUP BY 1),
"""


@query("mann_whitney", "WITH d AS (SELECT l_linestatus AS k, CASE l_returnflag WHEN 'A' THEN 'a' ELSE 'b' END AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), " + _RANKED + """
z AS (SELECT *, ra - na * (na + 1) / 2 AS u, (ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na::DOUBLE * nb / 12 * (na + nb + 1 - tie / ((na + nb)::DOUBLE * (na + nb - 1)))) AS z,
  (abs(ra - na * (na + 1) / 2 - na * nb / 2) - 0.5::DOUBLE) / sqrt(na::DOUBLE * nb / 12 * (na + nb + 1 - tie / ((na + nb)::DOUBLE * (na + nb - 1)))) AS zc FROM g)
SELECT k AS l_linestatus, na AS n_a, nb AS n_b, round(u, 2) AS u, round(z, 5) AS z, round(""" + _P.replace("abs(z)", "abs(zc)").replace("-z * z", "-zc * zc") + """, 5) AS p, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d FROM z""")
def _(spark, sf):
    m = stats.mann_whitney(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity", "A", "R")
    return rounded(m.withColumns({"u": F.round("u", 2), "z": F.round("z", 5), "p": F.round("p", 5)}))


@query("kruskal_wallis", """WITH r AS (SELECT o_orderstatus AS k, o_orderpriority AS g, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, round(o_totalprice, -3)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY o_orderstatus, round(o_totalprice, -3)) AS tc FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY round(o_totalprice, -3))),
s AS (SELECT k, g, count(*) AS n, sum(rk) AS rs, sum(tc::DOUBLE * tc - 1) AS tie FROM r GROUP BY 1, 2)
, h AS (SELECT s.k AS o_orderstatus, count(*) AS k, sum(n)::BIGINT AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - sum(tie) / (sum(n)::DOUBLE * sum(n) * sum(n) - sum(n))) AS h FROM s GROUP BY s.k)
SELECT o_orderstatus, k, n, round(h, 5) AS h, round(exp(-h / 2) * (1 + h / 2), 5) AS p FROM h""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", F.round("o_totalprice", -3))
    return rounded(stats.kruskal(o, ["o_orderstatus"], "o_orderpriority", "v"), 5)


@query("fdr_q_values", """WITH p AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 11 <> 0 THEN (o_totalprice % 997) / 1000 END AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o_orderkey) AS rk, count(*) OVER (PARTITION BY s) AS n FROM p WHERE p IS NOT NULL),
q AS (SELECT o_orderkey, least(1, min(p * n / rk) OVER (PARTITION BY s ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT o_orderkey, round(q, 6) AS q FROM p LEFT JOIN q USING (o_orderkey)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_totalprice") % 997) / 1000).alias("p"))
    return rounded(stats.fdr(o, ["s"], "p", ["o_orderkey"]).select("o_orderkey", "q"))


@query("window_contiguity", "SELECT user_id, count(*) AS n_rows, count(DISTINCT day(ts)) AS n_windows, max(day(ts)) - min(day(ts)) + 1 AS span, max(day(ts)) - min(day(ts)) + 1 - count(DISTINCT day(ts)) AS n_gaps, count(*) - count(DISTINCT day(ts)) AS n_duplicates, max(day(ts)) - min(day(ts)) + 1 = count(DISTINCT day(ts)) AS contiguous FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("d"))
    return stats.window_contiguity(e, ["user_id"], "d")


@query("cell_validity", "WITH " + SAMPLES + """, c AS (SELECT group_id, day(ts) AS d, participant, count(*) AS n FROM s GROUP BY ALL)
SELECT group_id, d, count(*) AS n_cells, count(*) FILTER (n >= 2) AS n_valid, count(*) FILTER (n >= 2) > 0 AS any_valid, count(*) FILTER (n >= 2) >= 4 AS all_valid FROM c GROUP BY 1, 2""")
def _(spark, sf):
    c = samples(spark, sf).groupBy("group_id", F.dayofmonth("ts").cast("long").alias("d"), "participant").agg(F.count("*").alias("n"))
    return stats.cell_validity(c, ["group_id", "d"], F.col("n") >= 2, 4)


@query("modality_usability", "WITH " + SAMPLES + """, u AS (SELECT DISTINCT user_id FROM s), g AS (SELECT user_id, t.task_id FROM u, (SELECT unnest(['T1','T2','T3','T4']) AS task_id) t),
a AS (SELECT user_id, task_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM s GROUP BY 1, 2), j AS (SELECT g.task_id, coalesce(c, 0) AS c, coalesce(v, 0) AS v FROM g LEFT JOIN a USING (user_id, task_id))
SELECT task_id, count(*) AS n_expected, count(*) FILTER (c > 0) AS n_physio, round(count(*) FILTER (c > 0) * 100.0::DOUBLE / count(*), 6) AS pct_physio, count(*) FILTER (v > 2) AS n_pupil, round(count(*) FILTER (v > 2) * 100.0::DOUBLE / count(*), 6) AS pct_pupil,
  count(*) FILTER (c > 0 AND v > 2) AS n_both, round(count(*) FILTER (c > 0 AND v > 2) * 100.0::DOUBLE / count(*), 6) AS pct_both FROM j GROUP BY 1""")
def _(spark, sf):
    s = samples(spark, sf)
    a = s.groupBy("user_id", "task_id").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("v"))
    grid = joins.against_expected(joins.expected_grid(s.select("user_id"), {"task_id": _TASKS[1:]}), a, ["user_id", "task_id"])
    physio, pupil = F.col("c") > 0, F.col("v") > 2
    return rounded(stats.usability(grid, ["user_id"], ["task_id"], {"physio": physio, "pupil": pupil, "both": physio & pupil}))


@query("flag_frequencies", "WITH " + SAMPLES + """, w AS (SELECT user_id, task_id, count(*) AS n, max(value) AS mx, min(value) AS mn FROM s GROUP BY 1, 2),
f AS (SELECT task_id, unnest([CASE WHEN n < 10 THEN 'few' END, CASE WHEN mx > 200 THEN 'spike' END, CASE WHEN mn < 2 THEN 'floor' END]) AS flag FROM w), t AS (SELECT task_id, count(*) AS t FROM w GROUP BY 1)
SELECT task_id, flag, count(*) AS n, round(count(*) * 100.0::DOUBLE / max(t), 6) AS pct FROM f JOIN t USING (task_id) WHERE flag IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    w = samples(spark, sf).groupBy("user_id", "task_id").agg(F.count("*").alias("n"), F.max("value").alias("mx"), F.min("value").alias("mn"))
    w = w.withColumn("flags", X.flag_text({"few": F.col("n") < 10, "spike": F.col("mx") > 200, "floor": F.col("mn") < 2}))
    return rounded(stats.flag_frequencies(w, ["task_id"], "flags"))


@query("shared_attention", "WITH " + SAMPLES + """, c AS (SELECT group_id, day(ts) AS d, participant, event_type AS zone, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY group_id, d, participant) AS sh FROM c)
SELECT group_id, d, zone, round(sum(sh), 6) AS attention, count(*) AS n_people FROM p GROUP BY 1, 2, 3""")
def _(spark, sf):
    s = samples(spark, sf).select("group_id", F.dayofmonth("ts").cast("long").alias("d"), "participant", F.col("event_type").alias("zone"))
    return rounded(stats.shared_attention(s, ["group_id"], "d", "participant", "zone"))


@query("residualise", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - a - b * l_quantity, 3) AS residual FROM lineitem, f""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rounded(stats.residualise(li, "l_extendedprice", ["l_quantity"], "residual").select("l_orderkey", "l_linenumber", "l_partkey", "residual"), 3)


@query("partial_correlation", """WITH c AS (SELECT l_returnflag, count(*) AS n, corr(l_extendedprice, l_tax) AS a, corr(l_extendedprice, l_quantity) AS b, corr(l_tax, l_quantity) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial_r FROM c""")
def _(spark, sf):
    return rounded(stats.partial_correlation(table(spark, sf, "lineitem"), "l_extendedprice", "l_tax", "l_quantity", ["l_returnflag"]))


@query("team_diversity", """WITH m AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_quantity AS a, l_discount * 100 AS b FROM lineitem),
d AS (SELECT x.k, avg(sqrt((x.a - y.a)**2 + (x.b - y.b)**2)) AS md FROM m x JOIN m y ON x.k = y.k AND x.i < y.i GROUP BY 1)
SELECT k, count(*) AS n_members, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_sd, min(a) AS a_min, max(a) AS a_max, round(avg(b), 6) AS b_mean, round(stddev_samp(b), 6) AS b_sd, round(min(b), 6) AS b_min, round(max(b), 6) AS b_max, round(max(md), 6) AS mean_distance FROM m LEFT JOIN d USING (k) GROUP BY 1""")
def _(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    return rounded(stats.team_diversity(m, ["k"], ["a", "b"]))


@query("step_audit", """WITH b AS (SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey::DOUBLE END AS c FROM orders), st AS (SELECT avg(p) AS m, stddev_samp(p) AS d FROM b), a AS (SELECT o_orderkey, CASE WHEN p < 450000 THEN least(greatest(p, m - 1.2 * d), m + 1.2 * d) END AS p, c FROM b, st)
SELECT 'clip' AS step, 'p' AS feature, count(*) FILTER (b.p IS NULL) AS nulls_before, count(*) FILTER (a.p IS NULL) AS nulls_after, count(*) FILTER (b.p IS NOT NULL AND a.p IS NULL) AS new_nulls, count(*) FILTER (b.p <> a.p) AS changed FROM b JOIN a USING (o_orderkey)
UNION ALL SELECT 'clip', 'c', count(*) FILTER (b.c IS NULL), count(*) FILTER (a.c IS NULL), 0, count(*) FILTER (b.c <> a.c) FROM b JOIN a USING (o_orderkey)""")
def _(spark, sf):
    b = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey").cast("double")).alias("c"))
    a = groups.winsorise(b, ["p"], 1.2)
    a = joins.join_on(a, b.select("o_orderkey", F.col("p").alias("p0")), ["o_orderkey"]).withColumn("p", F.when(F.col("p0") < 450000, F.col("p"))).drop("p0")
    return stats.step_audit(b, a, ["o_orderkey"], ["p", "c"], "clip")


@query("state_occupancy", "SELECT user_id, " + ", ".join(f"round(count(*) FILTER (event_type = '{k}') * 1.0::DOUBLE / count(*), 6) AS share_{k}" for k in ("click", "view", "error", "signup", "purchase")) + ", count(*) AS n_rows FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(stats.shares(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "error", "signup", "purchase"]))


@query("adjusted_rand", """WITH c AS (SELECT o_orderstatus AS a, o_custkey % 3 AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), i AS (SELECT sum(m * (m - 1) / 2) AS i FROM (SELECT sum(n) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS j FROM (SELECT sum(n) AS m FROM c GROUP BY b)),
k AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c) SELECT n::BIGINT AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 8) AS ari FROM k, i, j""")
def _(spark, sf):
    return rounded(stats.adjusted_rand(table(spark, sf, "orders").withColumn("b", F.col("o_custkey") % 3), "o_orderstatus", "b"), 8)


def _weighted(ident: str, rows: str, n_boot: int, seed: int) -> str:
    """SQL of ``rows`` times the replicates b, with a Poisson(1) count w: whole-number arithmetic, as in the sampling operators."""
    fifth = lambda x: f"((({x} * {x}) % P) * (({x} * {x}) % P) % P * {x} % P)"
    y = f"SELECT *, ({ident} % P * 48271 + {seed} * 69621 + 11) % P AS x0 FROM {rows}"
    z = f"SELECT * EXCLUDE (x0), ({fifth('x0')} + b * 40692) % P AS x1 FROM ({y}), (SELECT unnest(range(1, {n_boot + 1})) AS b)"
    u = f"SELECT * EXCLUDE (x1), ({fifth('x1')} + 12345) % P AS x2 FROM ({z})"
    count = " + ".join(f"(u >= {t})::INT" for t in sampling.poisson_steps())
    return f"SELECT * EXCLUDE (u), {count} AS w FROM (SELECT * EXCLUDE (x2), {fifth('x2')} AS u FROM ({u}))".replace("P", str(sampling.PRIME))


@query("bootstrap_mean", f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus, o_totalprice AS v FROM orders), r AS (SELECT o_orderstatus, b, sum(w * v) / sum(w) AS m FROM ({_weighted("id", "o", 100, 1)}) GROUP BY 1, 2),
q AS (SELECT o_orderstatus, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM r GROUP BY 1)
SELECT o_orderstatus, round(avg(v), 4) AS mean, count(*) AS n, round(any_value(lo), 4) AS ci_low, round(any_value(hi), 4) AS ci_high FROM o JOIN q USING (o_orderstatus) GROUP BY 1""")
def _(spark, sf):
    return rounded(sampling.bootstrap_mean(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey", 100), 4)


@query("group_bootstrap_r2", f"""WITH g AS (SELECT l_suppkey AS id, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS q, sum((l_extendedprice - l_quantity * 1100) * (l_extendedprice - l_quantity * 1100)) AS e FROM lineitem GROUP BY 1),
r AS (SELECT b, 1 - sum(w * e) / (sum(w * q) - sum(w * s) * sum(w * s) / sum(w * n)) AS r FROM ({_weighted("id", "g", 200, 1)}) GROUP BY 1)
SELECT round((SELECT 1 - sum(e) / (sum(q) - sum(s) * sum(s) / sum(n)) FROM g), 7) AS r2, (SELECT count(*) FROM g) AS n_groups, round(quantile_cont(r, 0.025), 7) AS ci_low, round(quantile_cont(r, 0.975), 7) AS ci_high FROM r""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1100)
    return rounded(stats.group_bootstrap_r2(d, "l_suppkey", "l_extendedprice", "guess"), 7)


@query("matched_agreement", """WITH RECURSIVE c AS (SELECT o_orderstatus AS a, o_custkey % 3 AS b, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT a, [b] AS used, n AS total FROM c WHERE a = 'F'
  UNION ALL SELECT c.a, list_append(used, c.b), total + n FROM p JOIN c ON c.a = CASE p.a WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' END AND NOT list_contains(used, c.b))
SELECT (SELECT count(*) FROM orders) AS n, round(max(total) * 1.0::DOUBLE / (SELECT count(*) FROM orders), 8) AS agreement FROM p""")
def _(spark, sf):
    return rounded(stats.matched_agreement(table(spark, sf, "orders").withColumn("b", F.col("o_custkey") % 3), "o_orderstatus", "b"), 8)


@query("annotation_context", "WITH " + SAMPLES + """SELECT user_id, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) AS n_events, round(max(t) - min(t), 4) AS span_s FROM s GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.annotation_context(samples(spark, sf), ["user_id"], "event_type", ["error", "signup"], "t"), 4)


@query("clock_quality", "WITH " + SAMPLES + """, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM s), m AS (SELECT user_id, count(*) AS n, coalesce(min(dt), 0) >= 0 AS monotone, max(dt) AS mg, (count(*) - 1) / (max(t) - min(t)) AS r, quantile_cont(dt, 0.5) AS md FROM d GROUP BY 1),
k AS (SELECT user_id, quantile_cont(abs(dt - md), 0.5) AS mad FROM d JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, n, monotone, round(mg, 3) AS max_gap, round(r * 1e6, 4) AS rate_uhz, round(md, 3) AS median_step, round(mad, 3) AS mad_step FROM m JOIN k USING (user_id)""")
def _(spark, sf):
    c = stats.clock_quality(samples(spark, sf), ["user_id"], ["event_id"], "t")
    return c.select("user_id", "n", "monotone", *[F.round(x, 3).alias(x) for x in ("max_gap", "median_step", "mad_step")], F.round(F.col("rate") * 1e6, 4).alias("rate_uhz"))


@query("clock_fit", "WITH " + SAMPLES + """, d AS (SELECT user_id, event_id::DOUBLE AS x, t - 1704067200.0::DOUBLE AS y FROM s), f AS (SELECT user_id, regr_slope(y, x) AS sl, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT user_id, avg(abs(y - my - sl * (x - mx))) AS e, sqrt(avg((y - my - sl * (x - mx))**2)) AS q FROM d JOIN f USING (user_id) GROUP BY 1)
SELECT user_id, n, round(sl, 6) AS scale, round(my - sl * mx, 3) AS "offset", round((sl - 1) * 1e6, 0) AS drift_ppm, round(e, 3) AS mean_abs_residual, round(q, 3) AS rmse FROM f JOIN r USING (user_id)""")
def _(spark, sf):
    d = samples(spark, sf).select("user_id", F.col("event_id").cast("double").alias("x"), (F.col("t") - 1704067200.0).alias("y"))
    f = stats.clock_fit(d, ["user_id"], "x", "y")
    return f.select("user_id", "n", F.round("scale", 6).alias("scale"), F.round("drift_ppm", 0).alias("drift_ppm"), *[F.round(c, 3).alias(c) for c in ("offset", "mean_abs_residual", "rmse")])


@query("piecewise_clock_fit", "WITH " + SAMPLES + """, d AS (SELECT user_id % 5 AS dev, event_id::DOUBLE AS x, t - 1704067200.0::DOUBLE AS y FROM s), c AS (SELECT *, (row_number() OVER (PARTITION BY dev ORDER BY x) - 1) // 300 AS chunk FROM d)
SELECT dev, chunk, count(*) AS n, min(x) AS t0, round(regr_slope(y, x), 6) AS scale FROM c GROUP BY 1, 2""")
def _(spark, sf):
    d = samples(spark, sf).select((F.col("user_id") % 5).alias("dev"), F.col("event_id").cast("double").alias("x"), (F.col("t") - 1704067200.0).alias("y"))
    return rounded(stats.piecewise_clock_fit(d, ["dev"], "x", "y", 300).select("dev", "chunk", "n", "t0", "scale"))


@query("better_fit", """WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS err, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS err, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.err <= b.err THEN 'a' ELSE 'b' END AS chosen, round(CASE WHEN b.k IS NULL OR a.err <= b.err THEN a.err ELSE b.err END, 6) AS err, CASE WHEN b.k IS NULL OR a.err <= b.err THEN a.n ELSE b.n END AS n FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    fit = lambda st: table(spark, sf, "orders").filter(F.col("o_orderstatus") == st).groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("err"), F.count("*").alias("n"))
    return rounded(stats.better_fit(fit("F"), fit("O"), ["k"], "err"))


@query("feed_offsets", "WITH " + SAMPLES + """, m AS (SELECT user_id % 20 AS feed, quantile_cont(t - 1704067200.0::DOUBLE - event_id * 259.2::DOUBLE, 0.5) AS m FROM s GROUP BY 1), k AS (SELECT quantile_cont(m, 0.5) AS mm FROM m)
SELECT feed, round(m - mm, 3) AS start_offset FROM m, k WHERE abs(m - mm) <= 2000""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("feed", F.col("user_id") % 20)
    return rounded(stats.feed_offsets(s, "feed", "t", F.col("t") - 1704067200.0 - F.col("event_id") * 259.2, 2000.0), 3)


@query("item_coverage", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")
def _(spark, sf):
    return stats.item_coverage(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("signal_rating_discordance", """WITH p AS (SELECT o_custkey, avg(o_totalprice) AS s FROM orders GROUP BY 1), j AS (SELECT o_custkey, s, c_acctbal AS r FROM p JOIN customer ON o_custkey = c_custkey), z AS (SELECT o_custkey, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS zs, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS zr FROM j)
SELECT o_custkey, round(zs, 6) AS z_signal, round(zr, 6) AS z_rating, round(abs(zs - zr), 6) AS discordance, zs - zr > 1 AS signal_over_rating, zr - zs > 1 AS rating_over_signal FROM z""")
def _(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("s"))
    j = p.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("r")), "o_custkey")
    return rounded(stats.discordance(j, "s", "r").drop("s", "r"))


@query("disagreement", "SELECT c_nationkey, 'c_acctbal' AS feature, round(stddev_samp(c_acctbal), 6) AS sd, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'c_custkey', round(stddev_samp(c_custkey), 6), count(*) FROM customer GROUP BY 1")
def _(spark, sf):
    return rounded(stats.disagreement(table(spark, sf, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"]))


@query("segment_summary", """SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM customer), 6) AS pct, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1""")
def _(spark, sf):
    c = stats.category_shares(table(spark, sf, "customer"), ["c_mktsegment"], ["c_acctbal"])
    return rounded(c.withColumnRenamed("c_acctbal_mean", "mean"))


@query("rating_table", f"""SELECT l_returnflag, feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max FROM ({_LONG}) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(stats.rating_table(table(spark, sf, "lineitem"), ["l_returnflag"], _NUM))


@query("family_overview", f"""WITH l AS (SELECT CASE WHEN feature IN ('l_discount', 'l_tax') THEN 'rate' ELSE 'amount' END AS family, feature, CASE WHEN feature = 'l_tax' AND value > 0.05 THEN NULL WHEN feature = 'l_discount' AND value < 0.09 THEN 0 ELSE value END AS value FROM ({_LONG})),
f AS (SELECT family, feature, count(value) * 100.0::DOUBLE / count(*) AS c, count(*) FILTER (value = 0) * 100.0::DOUBLE / count(value) AS z, count(DISTINCT value) AS u, stddev_samp(value) AS sd, skewness(value) AS k FROM l GROUP BY 1, 2)
SELECT family, count(*) AS n_features, round(quantile_cont(c, 0.5), 6) AS median_coverage_pct, count(*) FILTER (c < 80) AS n_low_coverage, count(*) FILTER (u <= 2 OR sd = 0) AS n_near_constant, count(*) FILTER (z >= 80) AS n_sparse, count(*) FILTER (abs(k) >= 1) AS n_strongly_skewed FROM f GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumns({"l_tax": F.when(F.col("l_tax") <= 0.05, F.col("l_tax")), "l_discount": F.when(F.col("l_discount") < 0.09, 0.0).otherwise(F.col("l_discount"))})
    f = stats.feature_flags(stats.feature_inventory(d, _NUM)).withColumn("family", F.when(F.col("feature").isin("l_discount", "l_tax"), "rate").otherwise("amount"))
    return rounded(stats.family_overview(f, ["family"]))


@query("variation_summary", f"""WITH v AS (SELECT l_suppkey, feature, stddev_samp(value) / (avg(value) + 1e-9) * 100 AS cv FROM ({_LONG.replace('l_returnflag', 'l_suppkey')}) GROUP BY 1, 2 HAVING count(value) >= 3)
SELECT feature, count(*) AS n_keys, round(avg(cv), 6) AS mean, round(min(cv), 6) AS min, round(max(cv), 6) AS max FROM v GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.variation_summary(table(spark, sf, "lineitem"), ["l_suppkey"], _NUM))


_ANSWERS = """WITH r AS (SELECT o_orderkey, o_custkey AS person, o_custkey % 40 AS grp, o_orderpriority AS task, o_orderstatus AS kind, 'q' || CAST(o_orderkey % 7 AS VARCHAR) AS item, o_totalprice AS v FROM orders),
u AS (SELECT DISTINCT grp, person, task FROM r)
"""
_UNIT = ["grp", "person", "task"]


def _answers(spark, sf):
    item = F.concat(F.lit("q"), (F.col("o_orderkey") % 7).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), (F.col("o_custkey") % 40).alias("grp"), F.col("o_orderpriority").alias("task"),
                                             F.col("o_orderstatus").alias("kind"), item.alias("item"), F.col("o_totalprice").alias("v"))


@query("response_completion", _ANSWERS + "SELECT task, count(DISTINCT grp) AS n_groups, count(*) AS n_units FROM u GROUP BY 1")
def _(spark, sf):
    return stats.completion_summary(stats.response_units(_answers(spark, sf), _UNIT), ["task"], "grp")


@query("response_presence", _ANSWERS + """SELECT grp, task, max((kind = 'F')::INT) AS "F", max((kind = 'O')::INT) AS "O", max((kind = 'P')::INT) AS "P", least(max((kind = 'F')::INT), max((kind = 'O')::INT), max((kind = 'P')::INT)) AS all_streams_present FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return stats.stream_presence(_answers(spark, sf), ["grp", "task"], "kind", ["F", "O", "P"])


_ITEMS = _ANSWERS.rstrip() + """,
f AS (SELECT grp, person, task, item, arg_min(v, o_orderkey) AS v FROM r WHERE kind <> 'P' GROUP BY ALL), e AS (SELECT task, count(*) AS n FROM u GROUP BY 1),
i AS (SELECT task, item, count(v) AS n_present, avg(v) AS mean, stddev_samp(v) AS std, n AS expected_units FROM f JOIN e USING (task) GROUP BY task, item, n)
"""


def _items(spark, sf):
    r = _answers(spark, sf)
    return stats.item_completeness(r.filter("kind <> 'P'"), stats.response_units(r, _UNIT), _UNIT, "task", "item", "v", "o_orderkey")


@query("item_completeness", _ITEMS + "SELECT task, item, n_present, round(mean, 5) AS mean, round(std, 5) AS std, expected_units, expected_units - n_present AS n_missing, round(100.0::DOUBLE * n_present / expected_units, 5) AS pct_present FROM i")
def _(spark, sf):
    return rounded(_items(spark, sf), 5)


@query("core_completeness", _ITEMS + """SELECT task, CASE task WHEN '1-URGENT' THEN 2 ELSE 1 END::INT AS n_items, sum(n_present)::BIGINT AS n_present, sum(expected_units)::BIGINT AS n_expected, sum(expected_units - n_present)::BIGINT AS n_missing, round(100.0::DOUBLE * sum(n_present) / sum(expected_units), 5) AS pct_present
FROM i WHERE (task = '1-URGENT' AND item IN ('q1', 'q2')) OR (task = '2-HIGH' AND item = 'q3') GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.core_completeness(_items(spark, sf), "task", "item", {"1-URGENT": ["q1", "q2"], "2-HIGH": ["q3"]}), 5)


@query("scale_means", _ANSWERS + "SELECT grp, person, task, round(avg(v), 5) AS trust_mean FROM r WHERE item IN ('q1', 'q4') GROUP BY ALL")
def _(spark, sf):
    return rounded(stats.scale_means(_answers(spark, sf), _UNIT, "item", "v", F.col("item").isin("q1", "q4"), "trust_mean"), 5)


@query("person_profile", """SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_tasks, count(DISTINCT CASE WHEN l_quantity > 45 THEN l_returnflag END) AS n_valid_tasks, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_sd, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.person_profile(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity"], "l_returnflag", F.col("l_quantity") > 45))


@query("variation", "SELECT o_custkey, round(stddev_samp(o_totalprice) / (avg(o_totalprice) + 1e-9) * 100, 6) AS cv_pct, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(stats.variation(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice"))


@query("state_profiles", """WITH m AS (SELECT event_type, 'value' AS feature, avg(value) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'event_id', avg(event_id) FROM events GROUP BY 1)
SELECT event_type, feature, round(mean, 6) AS mean, round((mean - avg(mean) OVER (PARTITION BY feature)) / stddev_pop(mean) OVER (PARTITION BY feature), 6) AS z FROM m""")
def _(spark, sf):
    return rounded(stats.state_profiles(table(spark, sf, "events"), "event_type", ["value", "event_id"]))


@query("occupancy_rating_correlation", """WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'click') * 1.0::DOUBLE / count(*) AS share_click, count(*) FILTER (event_type = 'error') * 1.0::DOUBLE / count(*) AS share_error, avg(value) AS rating FROM events GROUP BY 1)
SELECT 'share_click' AS a, 'rating' AS b, count(*) AS n, round(corr(share_click, rating), 6) AS r FROM p UNION ALL SELECT 'share_error', 'rating', count(*), round(corr(share_error, rating), 6) FROM p""")
def _(spark, sf):
    e = table(spark, sf, "events")
    p = stats.shares(e, ["user_id"], "event_type", ["click", "error"]).join(e.groupBy("user_id").agg(F.avg("value").alias("rating")), "user_id")
    return rounded(stats.pearson_table(p, [], [("share_click", "rating"), ("share_error", "rating")]))
