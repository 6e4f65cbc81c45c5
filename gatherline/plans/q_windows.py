"""Queries over windows, streams, peaks, phases and synchrony."""

from pyspark.sql import functions as F

from gatherline.functions import exprs as X
from gatherline.operators import groups, signals, windows
from gatherline.operators.ordered import settle
from gatherline.plans.bindings import ANNOTATIONS, DAY, SAMPLES, TURNS, annotations, samples, turns, vectors
from gatherline.plans.registry import query, rounded, table

STREAM = ["user_id"]

_W = "WITH " + SAMPLES + """, st AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1),
x AS (SELECT s.*, t0, t1, unnest(range(0, CAST(ceil((t1 - t0) / 43200.0) AS BIGINT) + 1)) AS window_index FROM s JOIN st USING (user_id)),
w AS (SELECT *, t0 + window_index * 43200.0::DOUBLE AS window_start, t0 + window_index * 43200.0::DOUBLE + 86400.0::DOUBLE AS window_end FROM x
      WHERE t >= t0 + window_index * 43200.0::DOUBLE AND t < t0 + window_index * 43200.0::DOUBLE + 86400.0::DOUBLE
        AND t0 + window_index * 43200.0::DOUBLE + 86400.0::DOUBLE <= t1 + 1e-6)"""

_SLOPE = "CASE WHEN count(value) >= 2 AND var_pop(t) + (avg(t) - min(t))**2 > 0 THEN covar_pop(t, value) / (var_pop(t) + (avg(t) - min(t))**2) END"


def _windowed(spark, sf):
    return windows.anchored_windows(samples(spark, sf), STREAM, "t", DAY, DAY / 2)


@query("sliding_windows", _W + """
SELECT user_id, window_index, round(window_start, 3) AS window_start, round(window_end, 3) AS window_end, count(*) AS n, round(avg(value), 6) AS mean
FROM w GROUP BY ALL""")
def _(spark, sf):
    g = _windowed(spark, sf).groupBy("user_id", "window_index", F.round("window_start", 3).alias("window_start"), F.round("window_end", 3).alias("window_end"))
    return rounded(g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("window_signal_summary", _W + f"""
SELECT user_id, window_index, round(count(CASE WHEN value < 150 THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS coverage_pct, round(avg(v), 6) AS mean,
       round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round({_SLOPE.replace('value', 'v')} * 1e6, 3) AS slope,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT user_id, window_index, CASE WHEN value < 150 THEN t - window_start END AS t, CASE WHEN value < 150 THEN value END AS v, value FROM w) GROUP BY ALL""")
def _(spark, sf):
    w = _windowed(spark, sf).withColumns({"value": X.in_range("value", None, 149.9999999), "t": F.col("t") - F.col("window_start")})
    out = signals.signal_summary(w, ["user_id", "window_index"], "t", "value")
    return rounded(out.withColumn("slope", F.round(F.col("slope") * 1e6, 3)))


@query("task_signal_summary", "WITH " + SAMPLES + f"""
SELECT user_id, task_id, 100.0::DOUBLE AS coverage_pct, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
       round({_SLOPE} * 1e6, 3) AS slope, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM s GROUP BY 1, 2""")
def _(spark, sf):
    out = signals.signal_summary(samples(spark, sf), ["user_id", "task_id"], "t", "value")
    return rounded(out.withColumn("slope", F.round(F.col("slope") * 1e6, 3)))


@query("slopes", "WITH " + SAMPLES + f"""
SELECT user_id, round({_SLOPE} * 1e6, 3) AS slope_ref, round(regr_slope(value, t) * 1e6, 3) AS slope_ols FROM s GROUP BY 1""")
def _(spark, sf):
    return samples(spark, sf).groupBy("user_id").agg(
        F.round(signals.slope_ref("t", "value") * 1e6, 3).alias("slope_ref"), F.round(signals.slope_ols("t", "value") * 1e6, 3).alias("slope_ols"))


@query("vector_features", """
WITH m0 AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
         sqrt(l_quantity**2 + coalesce((CASE WHEN l_tax > 0.01 THEN l_tax * 100 END)**2, 0) + (l_discount * 100)**2) AS mag, (l_tax > 0.01)::INT::DOUBLE AS ok FROM lineitem),
m1 AS (SELECT *, mag - lag(mag) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS j,
         quantile_cont(mag, 0.5) OVER (PARTITION BY l_suppkey) AS med FROM m0)
SELECT l_suppkey, round(avg(ok) * 100, 6) AS coverage_pct, round(avg(mag), 6) AS motion_mean, round(stddev_pop(mag), 6) AS motion_std, round(max(mag), 6) AS motion_max,
       round(avg(abs(mag - med)), 6) AS dynamic_mean, round(avg(abs(j)) * 25, 6) AS jerk_mean, round(avg((mag > 40)::INT), 6) AS high_fraction,
       round(quantile_cont(mag, 0.95), 6) AS motion_p95, round(quantile_cont(abs(mag - med), 0.95), 6) AS dynamic_p95, round(quantile_cont(abs(j) * 25, 0.95), 6) AS jerk_p95
FROM m1 GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "ax": F.col("l_quantity"), "ay": F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 100), "az": F.col("l_discount") * 100})
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return rounded(signals.vector_features(li, ["l_suppkey"], order, ["ax", "ay", "az"], 25.0, 40.0))


@query("sample_rate", "WITH " + SAMPLES + """, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM s)
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(1e6 / quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5), 6) END AS rate_uhz FROM d GROUP BY 1""")
def _(spark, sf):
    r = signals.sample_rate(samples(spark, sf), STREAM, "t")
    return rounded(r.select("user_id", "n", (F.col("rate_hz") * 1e6).alias("rate_uhz")))


@query("fixed_bins", "WITH " + ANNOTATIONS + """
SELECT group_id, task_id, CAST(floor(onset / 43200.0::DOUBLE) AS BIGINT) AS window_index, count(*) AS n FROM ann WHERE onset >= 0 GROUP BY ALL""")
def _(spark, sf):
    return windows.fixed_bins(annotations(spark, sf), "onset", DAY / 2).groupBy("group_id", "task_id", "window_index").agg(F.count("*").alias("n"))


@query("covered_window_zero_fill", "WITH " + SAMPLES + """, sp AS (SELECT user_id, task_id, min(t) AS a, max(t + value) AS z FROM s GROUP BY 1, 2),
g AS (SELECT user_id, task_id, unnest(range(CAST(greatest(floor((a - 5400.0::DOUBLE) / 21600.0::DOUBLE), 0) AS BIGINT), CAST(floor((z + 5400.0::DOUBLE) / 21600.0::DOUBLE) AS BIGINT) + 1)) AS window_index FROM sp),
f AS (SELECT user_id, task_id, CAST(floor(t / 21600.0::DOUBLE) AS BIGINT) AS window_index, count(*) AS n, sum(value) AS v, avg(value) AS m FROM s GROUP BY ALL)
SELECT user_id, task_id, window_index, coalesce(n, 0) AS n, round(coalesce(v, 0), 6) AS v, round(m, 6) AS m FROM g LEFT JOIN f USING (user_id, task_id, window_index)""")
def _(spark, sf):
    s = samples(spark, sf)
    keys = ["user_id", "task_id"]
    spine = windows.covered_spine(s, keys, "t", F.col("t") + F.col("value"), 21600.0, 5400.0).select(*keys, "window_index")
    f = windows.fixed_bins(s, "t", 21600.0).groupBy(*keys, "window_index").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.avg("value").alias("m"))
    return rounded(windows.zero_fill(spine, f, keys, ["n", "v"]))


@query("member_pooling", _W + """, p AS (SELECT group_id, participant, window_index, avg(value) AS m FROM w GROUP BY ALL)
SELECT group_id, window_index, count(DISTINCT participant) AS n_members, count(m) AS m_n, round(avg(m), 8) AS m_mean, round(stddev_samp(m), 8) AS m_sd FROM p GROUP BY 1, 2""")
def _(spark, sf):
    p = _windowed(spark, sf).groupBy("group_id", "participant", "window_index").agg(F.avg("value").alias("m"))
    return signals.pool_members(p, ["group_id", "window_index"], ["m"], "participant", 8)


_DYADS = _W + """, p AS (SELECT group_id, participant, window_index, avg(value) AS m FROM w GROUP BY ALL),
mem AS (SELECT DISTINCT group_id, participant FROM p),
pr AS (SELECT x.group_id, x.participant AS a, y.participant AS b FROM mem x JOIN mem y ON x.group_id = y.group_id AND x.participant < y.participant),
bo AS (SELECT pr.group_id, a, b, window_index, max(m) FILTER (participant = a) AS xa, max(m) FILTER (participant = b) AS xb
       FROM pr JOIN p ON p.group_id = pr.group_id AND p.participant IN (a, b) GROUP BY ALL),
po AS (SELECT *, row_number() OVER (PARTITION BY group_id, a, b ORDER BY window_index) AS pos FROM bo),
lg AS (SELECT p1.group_id, p1.a, p1.b, l.lag, CASE WHEN count(*) >= 3 AND stddev_pop(p1.xa) > 0 AND stddev_pop(p2.xb) > 0 THEN corr(p1.xa, p2.xb) END AS c
       FROM po p1 JOIN (SELECT unnest(range(-2, 3)) AS lag) l ON true
       JOIN po p2 ON p1.group_id = p2.group_id AND p1.a = p2.a AND p1.b = p2.b AND p2.pos = p1.pos - l.lag
       WHERE p1.xa IS NOT NULL AND p2.xb IS NOT NULL GROUP BY ALL),
dy AS (SELECT group_id, a, b, max(c) FILTER (lag = 0) AS corr, max(c) AS best_corr, arg_max(lag, c) FILTER (c IS NOT NULL) AS best_lag FROM lg GROUP BY 1, 2, 3)
"""


def _dyads(spark, sf):
    p = _windowed(spark, sf).groupBy("group_id", "participant", "window_index").agg(F.avg("value").alias("m"))
    return signals.dyad_synchrony(p, ["group_id"], "participant", "window_index", "m")


@query("dyad_synchrony", _DYADS + """SELECT dy.group_id, dy.a, dy.b, round(corr, 6) AS corr, round(best_corr, 6) AS best_corr, best_lag, n AS window_count
FROM dy JOIN (SELECT group_id, a, b, count(*) AS n FROM bo GROUP BY 1, 2, 3) USING (group_id, a, b)""")
def _(spark, sf):
    return rounded(_dyads(spark, sf).withColumn("best_lag", F.col("best_lag").cast("long")))


@query("group_synchrony", _DYADS + """, gw AS (SELECT group_id, window_index, avg(m) AS m, count(DISTINCT participant) AS n FROM p GROUP BY 1, 2),
ga AS (SELECT group_id, count(*) AS n_windows, round(avg(m), 6) AS activity, round(avg(n), 6) AS members FROM gw GROUP BY 1),
gd AS (SELECT group_id, count(*) AS n_dyads, round(avg(corr), 6) AS mean_corr, round(avg(best_corr), 6) AS mean_best_corr FROM dy GROUP BY 1)
SELECT * FROM ga LEFT JOIN gd USING (group_id)""")
def _(spark, sf):
    p = settle(_windowed(spark, sf).groupBy("group_id", "participant", "window_index").agg(F.avg("value").alias("m")))
    gw = p.groupBy("group_id", "window_index").agg(F.avg("m").alias("m"), F.count_distinct("participant").alias("n"))
    ga = gw.groupBy("group_id").agg(F.count("*").alias("n_windows"), F.avg("m").alias("activity"), F.avg("n").alias("members"))
    gd = signals.dyad_synchrony(p, ["group_id"], "participant", "window_index", "m").groupBy("group_id").agg(F.count("*").alias("n_dyads"), F.avg("corr").alias("mean_corr"), F.avg("best_corr").alias("mean_best_corr"))
    return rounded(ga.join(gd, "group_id", "left"))


_BASE = "WITH " + SAMPLES + """, w AS (SELECT user_id, task_id, avg(value) AS m FROM s GROUP BY 1, 2),
q AS (SELECT user_id, avg(value) AS f FROM s WHERE task_id = 'T0' AND event_type = 'view' GROUP BY 1),
b AS (SELECT user_id, max(m) FILTER (task_id = 'T0') AS b, avg(m) FILTER (task_id <> 'T0') AS a, stddev_samp(m) FILTER (task_id <> 'T0') AS d,
             avg(m) AS am, stddev_samp(m) AS ad FROM w GROUP BY 1)
"""


def _tasks(spark, sf):
    return samples(spark, sf).groupBy("user_id", "task_id").agg(F.avg("value").alias("m"))


@query("baseline_delta", _BASE + """SELECT user_id, task_id, round(m, 6) AS m, round(m - coalesce(f, b, a), 6) AS m_delta,
  CASE WHEN d > 1e-9 THEN round((m - coalesce(f, b, a)) / d, 6) END AS m_dz FROM w JOIN b USING (user_id) LEFT JOIN q USING (user_id)""")
def _(spark, sf):
    s = samples(spark, sf)
    quiet = s.filter((F.col("task_id") == "T0") & (F.col("event_type") == "view")).groupBy("user_id").agg(F.avg("value").alias("m"))
    return rounded(groups.baseline_delta(_tasks(spark, sf), STREAM, "task_id", ["m"], preferred=quiet))


@query("baseline_z", _BASE + """SELECT user_id, task_id, round(m, 6) AS m, CASE WHEN ad > 0 THEN round((m - coalesce(b, am)) / ad, 6) ELSE 0.0 END AS m_bz FROM w JOIN b USING (user_id)""")
def _(spark, sf):
    return rounded(groups.baseline_z(_tasks(spark, sf), STREAM, "task_id", ["m"]))


@query("z_within_group", """
SELECT o_orderkey, CASE WHEN stddev_samp(o_totalprice) OVER w > 0 THEN round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) ELSE 0.0 END AS z
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def _(spark, sf):
    z = groups.z_within(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_totalprice"])
    return rounded(z.select("o_orderkey", F.col("o_totalprice_z").alias("z")))


@query("robust_z", """
WITH a AS (SELECT l_suppkey, median(l_extendedprice) AS med, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
m AS (SELECT l.l_suppkey, median(abs(l_extendedprice - med)) AS mad FROM lineitem l JOIN a USING (l_suppkey) WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 2 THEN round(CASE WHEN mad < 1e-9 THEN l_extendedprice - med ELSE (l_extendedprice - med) / (1.4826 * mad) END, 6) END AS z
FROM lineitem LEFT JOIN a USING (l_suppkey) LEFT JOIN m USING (l_suppkey)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    z = groups.robust_z(li, ["l_suppkey"], "l_extendedprice", "z", F.col("l_returnflag") != "A")
    return rounded(z.select("l_orderkey", "l_linenumber", "l_partkey", "z"))


@query("versus_group", """
SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER w, 6) AS delta, CASE WHEN stddev_pop(c_acctbal) OVER w > 0 THEN round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) END AS z
FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def _(spark, sf):
    v = groups.versus_group(table(spark, sf, "customer"), ["c_nationkey"], ["c_acctbal"])
    return rounded(v.select("c_custkey", F.col("c_acctbal_vs_group").alias("delta"), F.col("c_acctbal_group_z").alias("z")))


@query("share_and_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share,
       rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank_desc FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rounded(groups.share_and_rank(li, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "share", "rank_desc"))


@query("phase_durations", "WITH " + SAMPLES + """, e AS (SELECT user_id, task_id, max(t) + 60 AS z FROM s GROUP BY 1, 2)
SELECT event_id, round(coalesce(lead(t) OVER (PARTITION BY user_id, task_id ORDER BY t), z) - t, 5) AS phase_s FROM s JOIN e USING (user_id, task_id)""")
def _(spark, sf):
    s = groups.with_stats(samples(spark, sf).select("event_id", "user_id", "task_id", "t"), ["user_id", "task_id"], {"z": F.max("t") + 60})
    return rounded(windows.phase_durations(s, ["user_id", "task_id"], "t", "z").select("event_id", "phase_s"), 5)


@query("response_gaps", "WITH " + TURNS + """, g AS (SELECT conv_id, turn, speaker, "end", lead(speaker) OVER w AS ns, lead(onset) OVER w AS no FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY onset, "end"))
SELECT conv_id, turn, ns AS next_speaker, CASE WHEN ns <> speaker THEN round(no - "end", 6) END AS gap, CASE WHEN ns <> speaker THEN no - "end" < 0 END AS interrupted FROM g""")
def _(spark, sf):
    g = windows.response_gaps(turns(spark, sf), ["conv_id"], "speaker", "onset", "end")
    return rounded(g.select("conv_id", "turn", "next_speaker", "gap", "interrupted"))


@query("flag_runs", "WITH " + SAMPLES + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, value < 60 ORDER BY t) AS g FROM s)
SELECT user_id, count(*) AS n_rows, round(min(t), 3) AS run_start, round(max(t) - min(t), 5) AS duration FROM r WHERE value < 60 GROUP BY user_id, g HAVING count(*) >= 2 AND max(t) - min(t) <= 172800""")
def _(spark, sf):
    r = windows.flag_runs(samples(spark, sf), STREAM, ["t"], "t", F.col("value") < 60, 2, None, 172800.0)
    return r.select("user_id", "n_rows", F.round("run_start", 3).alias("run_start"), F.round("duration", 5).alias("duration"))


@query("fixations", "WITH " + SAMPLES + """, v AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((value - lag(value) OVER w)**2 + (event_id % 100 - lag(event_id % 100) OVER w)**2) AS dist FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
f AS (SELECT *, CASE WHEN dt IS NULL THEN true WHEN dt <= 0 OR dt > 86400 THEN false ELSE dist / dt <= 0.003 END AS still FROM v),
g AS (SELECT *, sum((NOT still)::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f)
SELECT user_id, round(min(t), 3) AS start, round(max(t) - min(t), 5) AS duration, count(*) AS n_samples, round(avg(value), 6) AS cx, round(avg(event_id % 100), 6) AS cy FROM g WHERE still GROUP BY user_id, run HAVING count(*) >= 3""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("y", (F.col("event_id") % 100).cast("double"))
    f = windows.fixations(s, STREAM, "t", "value", "y", 0.003, 86400.0)
    return rounded(f.select("user_id", F.round("start", 3).alias("start"), F.round("duration", 5).alias("duration"), "n_samples", "cx", "cy"))


@query("sample_speed", "WITH " + SAMPLES + """, v AS (SELECT user_id, t - lag(t) OVER w AS dt, CASE WHEN value < 200 THEN value END - lag(CASE WHEN value < 200 THEN value END) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
p AS (SELECT user_id, CASE WHEN dt > 0 THEN abs(d) / dt END AS speed FROM v)
SELECT user_id, round(avg(speed) * 1000, 6) AS speed_mean, round(quantile_cont(speed, 0.95) * 1000, 6) AS speed_p95 FROM p GROUP BY 1""")
def _(spark, sf):
    from gatherline.operators.ordered import agg_with_percentiles

    s = windows.with_speed(samples(spark, sf), STREAM, "t", ["value"], F.col("value") < 200)
    out = agg_with_percentiles(s, STREAM, [F.avg("speed").alias("speed_mean")], {"speed_p95": ("speed", 0.95)})
    return rounded(out.select("user_id", (F.col("speed_mean") * 1000).alias("speed_mean"), (F.col("speed_p95") * 1000).alias("speed_p95")))


@query("jump_rejection", "WITH " + SAMPLES + """, v AS (SELECT event_id, user_id, event_id AS o, CASE WHEN event_id % 17 <> 0 THEN value END AS x FROM s),
c AS (SELECT *, row_number() OVER w AS rn, coalesce(abs(x - lag(x) OVER w) / (o - lag(o) OVER w) > 0.8, false) AS cand FROM v WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY o)),
k AS (SELECT *, rn - coalesce(max(CASE WHEN NOT cand THEN rn END) OVER (PARTITION BY user_id ORDER BY o), 0) AS nth FROM c)
SELECT event_id, CASE WHEN NOT (cand AND nth % 2 = 1) THEN x END AS x FROM k UNION ALL SELECT event_id, NULL FROM v WHERE x IS NULL""")
def _(spark, sf):
    s = samples(spark, sf).select("event_id", "user_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"))
    return windows.reject_jumps(s, STREAM, "event_id", "x", 0.8).select("event_id", "x")


@query("jump_rejection_points", "WITH " + SAMPLES + """, v AS (SELECT event_id, user_id, event_id AS o, CASE WHEN event_id % 17 <> 0 THEN value END AS x, value * 0.5 + event_id % 3 AS y, event_id % 90 * 1.0::DOUBLE AS z FROM s),
c AS (SELECT *, row_number() OVER w AS rn, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) / (o - lag(o) OVER w) > 0.8, false) AS cand FROM v WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY o)),
k AS (SELECT *, rn - coalesce(max(CASE WHEN NOT cand THEN rn END) OVER (PARTITION BY user_id ORDER BY o), 0) AS nth FROM c),
b AS (SELECT *, cand AND nth % 2 = 1 AS bad FROM k)
SELECT event_id, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y, CASE WHEN NOT bad THEN z END AS z FROM b UNION ALL SELECT event_id, NULL, y, z FROM v WHERE x IS NULL""")
def _(spark, sf):
    s = samples(spark, sf).select("event_id", "user_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"),
                                  (F.col("value") * 0.5 + F.col("event_id") % 3).alias("y"), (F.col("event_id") % 90).cast("double").alias("z"))
    return windows.reject_jumps(s, STREAM, "event_id", ["x", "y", "z"], 0.8).select("event_id", "x", "y", "z")


_GAP = "WITH " + SAMPLES + """, v AS (SELECT event_id, user_id, t, CASE WHEN event_id % 5 NOT IN (0, 1) THEN value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY t) AS p FROM s),
n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN p END) OVER (PARTITION BY user_id ORDER BY p) AS lp, min(CASE WHEN x IS NOT NULL THEN p END) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM v),
j AS (SELECT n.*, a.x AS lx, b.x AS nx FROM n LEFT JOIN v a ON a.user_id = n.user_id AND a.p = n.lp LEFT JOIN v b ON b.user_id = n.user_id AND b.p = n.np)
"""


@query("gap_fill", _GAP + "SELECT event_id, round(coalesce(x, lx + (nx - lx) * (p - lp) / (np - lp), lx, nx), 5) AS y FROM j")
def _(spark, sf):
    s = samples(spark, sf).withColumn("x", F.when(~(F.col("event_id") % 5).isin(0, 1), F.col("value")))
    return rounded(windows.fill_gaps(s, STREAM, ["t"], "x", "y").select("event_id", "y"), 5)


@query("gap_fill_capped", _GAP + "SELECT event_id, round(coalesce(x, CASE WHEN np - lp - 1 <= 2 THEN lx + (nx - lx) * (p - lp) / (np - lp) END), 5) AS y FROM j")
def _(spark, sf):
    s = samples(spark, sf).withColumn("x", F.when(~(F.col("event_id") % 5).isin(0, 1), F.col("value")))
    return rounded(windows.fill_gaps(s, STREAM, ["t"], "x", "y", 2).select("event_id", "y"), 5)


@query("tonic_phasic", "WITH " + SAMPLES + """, m AS (SELECT event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS tonic FROM s)
SELECT event_id, round(tonic, 6) AS tonic, round(value - tonic, 6) AS phasic FROM m""")
def _(spark, sf):
    return rounded(windows.tonic_phasic(samples(spark, sf), STREAM, ["t"], "value", 3).select("event_id", "tonic", "phasic"))


_PEAKS = "WITH RECURSIVE " + SAMPLES + """, st AS (SELECT user_id, avg(value) + 0.5 * stddev_pop(value) AS thr FROM s GROUP BY 1),
n AS (SELECT user_id, t, value, row_number() OVER w AS pos, lag(value) OVER w AS p, lead(value) OVER w AS q FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT n.*, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM n JOIN st USING (user_id) WHERE value > thr AND value >= p AND value > q),
g AS (SELECT user_id, k, pos, pos AS last, true AS kept FROM c WHERE k = 1
      UNION ALL SELECT c.user_id, c.k, c.pos, CASE WHEN c.pos - g.last >= 6 THEN c.pos ELSE g.last END, c.pos - g.last >= 6 FROM g JOIN c ON c.user_id = g.user_id AND c.k = g.k + 1)
"""


@query("signal_peaks", _PEAKS + "SELECT user_id, count(*) AS n_peaks, CAST(sum(pos) AS BIGINT) AS pos_sum FROM g WHERE kept GROUP BY 1")
def _(spark, sf):
    p = windows.local_maxima(samples(spark, sf), STREAM, "t", "value", 6)
    return p.groupBy("user_id").agg(F.count("*").alias("n_peaks"), F.sum("pos").alias("pos_sum"))


_MAD_PEAKS = _PEAKS.replace("st AS (SELECT user_id, avg(value) + 0.5 * stddev_pop(value) AS thr FROM s GROUP BY 1)",
    "md AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM s GROUP BY 1), st AS (SELECT user_id, m + 0.8 * quantile_cont(abs(value - m), 0.5) AS thr FROM s JOIN md USING (user_id) GROUP BY user_id, m HAVING quantile_cont(abs(value - m), 0.5) > 0)")


@query("signal_peaks_mad", _MAD_PEAKS + "SELECT user_id, count(*) AS n_peaks, CAST(sum(pos) AS BIGINT) AS pos_sum FROM g WHERE kept GROUP BY 1")
def _(spark, sf):
    p = windows.local_maxima(samples(spark, sf), STREAM, "t", "value", 6, "mad")
    return p.groupBy("user_id").agg(F.count("*").alias("n_peaks"), F.sum("pos").alias("pos_sum"))


@query("scr_rate", _PEAKS + """SELECT user_id, coalesce(n, 0) AS n_peaks, round(coalesce(n, 0) / (max(t) - min(t)) * 86400, 6) AS per_day FROM s LEFT JOIN
  (SELECT user_id, count(*) AS n FROM g WHERE kept GROUP BY 1) USING (user_id) GROUP BY user_id, n""")
def _(spark, sf):
    s = samples(spark, sf)
    n = windows.local_maxima(s, STREAM, "t", "value", 6).groupBy("user_id").agg(F.count("*").alias("n"))
    span = s.groupBy("user_id").agg((F.max("t") - F.min("t")).alias("span"))
    return rounded(span.join(n, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_peaks"), (F.coalesce("n", F.lit(0)) / F.col("span") * 86400).alias("per_day")))


_BEATS = "WITH " + SAMPLES + """, ch AS (SELECT user_id, user_id % 3 AS dev, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS channel, t FROM s),
i AS (SELECT user_id, channel, t, (t - lag(t) OVER (PARTITION BY user_id, channel ORDER BY t)) / 86.4 AS ibi FROM ch),
tot AS (SELECT user_id, channel, count(ibi) AS n_ibi FROM i GROUP BY 1, 2),
ok AS (SELECT * FROM i WHERE ibi BETWEEN 300 AND 2000),
md AS (SELECT user_id, channel, quantile_cont(ibi, 0.5) AS med FROM ok GROUP BY 1, 2),
cl AS (SELECT ok.*, ibi - lag(ibi) OVER (PARTITION BY user_id, channel ORDER BY t) AS d FROM ok JOIN md USING (user_id, channel) WHERE abs(ibi - med) <= greatest(250, 0.25 * med)),
f AS (SELECT user_id, channel, count(*) AS n_clean, sqrt(avg(d * d)) AS rmssd, stddev_samp(ibi) AS sdnn, avg((abs(d) > 50)::INT) * 100 AS pnn50, 60000 / quantile_cont(ibi, 0.5) AS bpm FROM cl GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT user_id, channel, coalesce(n_clean, 0) AS n_clean, n_ibi, rmssd, sdnn, pnn50, bpm, coalesce(0.4::DOUBLE * n_clean / greatest(n_ibi, 1) + 0.15::DOUBLE + 0.2::DOUBLE * greatest(0, least(1, 1 - rmssd / 300)) + 0.1::DOUBLE * greatest(0, least(1, n_clean / 30.0::DOUBLE)), 0) AS quality FROM tot LEFT JOIN f USING (user_id, channel))
"""


def _beats(spark, sf):
    ch = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return windows.beat_features(samples(spark, sf).withColumn("channel", ch), ["user_id", "channel"], "t", 1 / 86.4)


@query("beat_features", _BEATS + """SELECT user_id, channel, n_clean, n_ibi, round(rmssd, 5) AS rmssd, round(sdnn, 5) AS sdnn, round(pnn50, 5) AS pnn50, round(bpm, 5) AS bpm, round(quality, 6) AS quality FROM q""")
def _(spark, sf):
    b = _beats(spark, sf)
    return rounded(b.select("user_id", "channel", "n_clean", "n_ibi", *[F.round(c, 5).alias(c) for c in ("rmssd", "sdnn", "pnn50", "bpm")], "quality"))


@query("best_beat_channel", _BEATS + """SELECT user_id, channel, round(quality, 6) AS quality FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY quality DESC, channel) = 1""")
def _(spark, sf):
    return rounded(windows.best_channel(_beats(spark, sf), STREAM, "channel").select("user_id", "channel", "quality"))


_EXPECTED = _BEATS.replace("+ 0.15::DOUBLE +", "+ 0.3::DOUBLE * greatest(0, least(1, 1 - abs(bpm - (40 + user_id % 50)) / 30.0::DOUBLE)) +")


@query("beat_features_expected", _EXPECTED + "SELECT user_id, channel, n_clean, round(quality, 6) AS quality FROM q")
def _(spark, sf):
    ch = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    s = samples(spark, sf).withColumn("channel", ch)
    e = s.select("user_id", "channel").distinct().withColumn("expected_bpm", (40 + F.col("user_id") % 50).cast("double"))
    return rounded(windows.beat_features(s, ["user_id", "channel"], "t", 1 / 86.4, e).select("user_id", "channel", "n_clean", "quality"))


@query("window_apply", "WITH " + SAMPLES + """SELECT user_id, CAST(floor((t - 1704067200) / 86400) AS BIGINT) AS window_index, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM s GROUP BY 1, 2""")
def _(spark, sf):
    s = samples(spark, sf).select("user_id", F.floor((F.col("t") - 1704067200.0) / 86400).alias("window_index"), "value")

    def spread(rows):
        v = rows["value"].to_numpy()
        return rows["user_id"].iat[0], rows["window_index"].iat[0], len(v), v.max() - v.min()

    return rounded(windows.window_apply(s, ["user_id"], spread, "user_id long, window_index long, n long, spread double"))


@query("task_progress", "WITH " + SAMPLES + """, p AS (SELECT event_id, user_id, task_id, value, (t - min(t) OVER w) / greatest(max(t + 60) OVER w - min(t) OVER w, 1e-9) AS p FROM s WINDOW w AS (PARTITION BY user_id, task_id)),
b AS (SELECT user_id, quantile_cont(value, 0.5) AS b FROM s WHERE task_id = 'T0' GROUP BY 1),
d AS (SELECT task_id, CASE WHEN p <= 1/3::DOUBLE THEN 'early' WHEN p <= 2/3::DOUBLE THEN 'middle' ELSE 'late' END AS segment, value - b AS delta FROM p LEFT JOIN b USING (user_id) WHERE task_id <> 'T0')
SELECT task_id, segment, count(delta) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(quantile_cont(delta, 0.5), 6) AS median FROM d GROUP BY 1, 2""")
def _(spark, sf):
    from gatherline.operators.ordered import agg_with_percentiles, exact_percentiles, join_on

    s = samples(spark, sf)
    p = windows.task_progress(s.withColumn("z", F.col("t") + 60), ["user_id", "task_id"], "t", "z")
    b = exact_percentiles(s.filter("task_id = 'T0'"), STREAM, {"b": ("value", 0.5)})
    d = join_on(p.filter("task_id <> 'T0'"), b, STREAM).withColumn("delta", F.col("value") - F.col("b"))
    return rounded(agg_with_percentiles(d, ["task_id", "segment"], [
        F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd")], {"median": ("delta", 0.5)}))


@query("quantile_labels", """
WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.33) AS a, quantile_cont(c_acctbal, 0.66) AS z FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN a = z THEN 'Moderate' WHEN c_acctbal <= a THEN 'Low' WHEN c_acctbal >= z THEN 'High' ELSE 'Moderate' END AS level FROM customer JOIN q USING (c_nationkey)""")
def _(spark, sf):
    return groups.quantile_labels(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "level").select("c_custkey", "level")


@query("overlap_dedup", "WITH " + ANNOTATIONS + """, o AS (SELECT *, round_even(onset / 3600 * 100, 0) / 100 AS k FROM ann WHERE type = 'OVL')
SELECT group_id, task_id, event_id FROM o QUALIFY row_number() OVER (PARTITION BY group_id, task_id, k ORDER BY duration DESC, event_id) = 1""")
def _(spark, sf):
    o = annotations(spark, sf).filter("type = 'OVL'").withColumn("hours", F.col("onset") / 3600)
    return windows.dedup_longest(o, ["group_id", "task_id"], "hours", "duration", "event_id").select("group_id", "task_id", "event_id")


@query("latest_response", """
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    return windows.latest(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_TOK = r"""regexp_extract_all(lower(regexp_replace(text, '\[.*?\]', '', 'g')), '[a-z0-9'']+')"""


@query("turn_cohesion", "WITH " + TURNS + f""", w AS (SELECT conv_id, turn, list_distinct({_TOK}) AS ws FROM u),
n AS (SELECT conv_id, turn, ws, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM w WHERE len(ws) > 0),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.ws, b.ws)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) AS c FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.rn = b.rn + 1)
SELECT conv_id, turn, round(c, 6) AS cohesion FROM w LEFT JOIN p USING (conv_id, turn)""")
def _(spark, sf):
    from gatherline.functions.text import tokens

    u = turns(spark, sf).withColumn("words", tokens("text"))
    return rounded(windows.turn_cohesion(u, ["conv_id"], ["turn"], "words").select("conv_id", "turn", "cohesion"))


@query("semantic_continuity", """
WITH e AS (SELECT vec_id, label, vec_id % 3 AS spk, vec_id // 20 AS win, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT *, lag(v) OVER w AS pv, lag(spk) OVER w AS ps FROM e WINDOW w AS (PARTITION BY win ORDER BY vec_id))
SELECT win, count(CASE WHEN ps <> spk THEN 1 END) AS n, round(avg(CASE WHEN ps <> spk THEN list_cosine_similarity(v, pv) END), 6) AS continuity FROM p GROUP BY 1""")
def _(spark, sf):
    e = vectors(spark, sf).select("vec_id", (F.col("vec_id") % 3).alias("spk"), F.expr("vec_id div 20").alias("win"), "embedding")
    c = windows.vector_continuity(e, ["win"], ["vec_id"], "embedding", "spk", X.cosine)
    return rounded(c.groupBy("win").agg(F.count("continuity").alias("n"), F.avg("continuity").alias("continuity")))


_TW = "WITH " + SAMPLES + """, off AS (SELECT group_id, quantile_cont(t - event_id * 259.2::DOUBLE, 0.5) AS o FROM s GROUP BY 1),
k AS (SELECT group_id, task_id, arg_min(t, event_id) FILTER (event_type = 'signup') AS s1, arg_min(t, event_id) AS f1, arg_max(t, event_id) FILTER (event_type = 'purchase') AS e1 FROM s GROUP BY 1, 2),
l AS (SELECT group_id, max(t) AS last FROM s GROUP BY 1),
r AS (SELECT group_id, task_id, coalesce(s1, f1) AS a, e1, lead(coalesce(s1, f1)) OVER (PARTITION BY group_id ORDER BY task_id) AS nx FROM k),
tw AS (SELECT group_id, task_id, a, CASE WHEN e1 > a THEN e1 ELSE coalesce(nx, last) END AS z FROM r JOIN l USING (group_id))
"""


def _task_windows(spark, sf):
    s = samples(spark, sf).withColumn("clock", F.col("event_id") * 259.2)
    return windows.task_windows(s, ["group_id"], "task_id", "t", "clock", F.col("event_type") == "signup", F.col("event_type") == "purchase", "event_id")


@query("task_windows", _TW + """SELECT group_id, task_id, round(a, 3) AS start, round(z - a, 3) AS duration, round(o, 3) AS "offset", round(z - o, 3) AS end_clock FROM tw JOIN off USING (group_id) WHERE z > a""")
def _(spark, sf):
    return rounded(_task_windows(spark, sf).select("group_id", "task_id", "start", "duration", "offset", "end_clock"), 3)


@query("break_windows", _TW + """, v AS (SELECT group_id, task_id, a, z, lead(task_id) OVER w AS nt, lead(a) OVER w AS na, row_number() OVER w AS rn FROM tw WHERE z > a WINDOW w AS (PARTITION BY group_id ORDER BY a)),
m AS (SELECT group_id, min(t) AS s0, max(t) AS s1 FROM s GROUP BY 1),
al AS (SELECT group_id, 'PRE' AS label, s0 AS b, a AS c FROM v JOIN m USING (group_id) WHERE rn = 1
  UNION ALL SELECT group_id, 'BREAK_' || task_id || '_' || nt, z, na FROM v WHERE nt IS NOT NULL
  UNION ALL SELECT group_id, 'POST', z, s1 FROM v JOIN m USING (group_id) WHERE nt IS NULL)
SELECT group_id, label, round(b, 3) AS start, round(c, 3) AS "end" FROM al WHERE c > b""")
def _(spark, sf):
    span = samples(spark, sf).groupBy("group_id").agg(F.min("t").alias("session_start"), F.max("t").alias("session_end"))
    return rounded(windows.break_windows(_task_windows(spark, sf), span, ["group_id"], "task_id"), 3)


@query("counter_reset_segment", "WITH " + SAMPLES + """, c AS (SELECT event_id, user_id, t, event_id % 3000 AS k FROM s),
d AS (SELECT *, CASE WHEN k + 0.5 < lag(k) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS r FROM c),
g AS (SELECT *, sum(r) OVER (PARTITION BY user_id ORDER BY t) AS seg FROM d)
SELECT event_id, user_id, k FROM g QUALIFY seg = max(seg) OVER (PARTITION BY user_id)""")
def _(spark, sf):
    s = samples(spark, sf).select("event_id", "user_id", "t", (F.col("event_id") % 3000).alias("k"))
    return windows.last_segment(s, STREAM, ["t"], "k").select("event_id", "user_id", "k")


@query("lag_search", "WITH " + SAMPLES + """, h AS (SELECT user_id % 10 AS dev, CAST(floor(t / 10800.0::DOUBLE) AS BIGINT) AS b, sum(value) FILTER (event_type = 'click') AS a, sum(value) FILTER (event_type = 'view') AS v FROM s GROUP BY 1, 2),
m AS (SELECT x.dev, l.lag, sum(x.a * y.v) AS ab, sum(x.a * x.a) AS aa, sum(y.v * y.v) AS bb, sqrt(avg((x.a - y.v)**2)) AS rmse
      FROM h x JOIN (SELECT unnest(range(-6, 7)) AS lag) l ON true JOIN h y ON x.dev = y.dev AND y.b = x.b - l.lag WHERE x.a IS NOT NULL AND y.v IS NOT NULL GROUP BY ALL),
z AS (SELECT *, ab / sqrt(aa * bb) AS score FROM m)
SELECT dev, arg_max(lag, (round(score, 9), -abs(lag), -lag)) AS best_lag, round(max(score), 6) AS best_score, round(min(rmse), 4) AS best_rmse FROM z GROUP BY 1""")
def _(spark, sf):
    pick = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    h = samples(spark, sf).groupBy((F.col("user_id") % 10).alias("dev"), F.floor(F.col("t") / 10800.0).alias("b")).agg(pick("click").alias("a"), pick("view").alias("v"))
    c = signals.cross_correlation(h, ["dev"], "b", "a", "v", 6)
    return c.select("dev", F.col("best_lag").cast("long").alias("best_lag"), F.round("best_score", 6).alias("best_score"), F.round("best_rmse", 4).alias("best_rmse"))
