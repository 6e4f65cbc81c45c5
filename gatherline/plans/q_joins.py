"""Queries over joins: keys, overlaps, nearest rows, expectations."""

from pyspark.sql import functions as F

from gatherline.functions import exprs as X
from gatherline.operators import groups, intervals, joins, signals
from gatherline.plans.bindings import ANNOTATIONS, SAMPLES, TURNS, annotations, samples, turns, vectors
from gatherline.plans.registry import query, rounded, table


@query("modality_full_join", "WITH " + SAMPLES + """,
c AS (SELECT group_id, task_id, participant, min(t) AS st, avg(value) AS click FROM s WHERE event_type = 'click' GROUP BY ALL),
v AS (SELECT group_id, task_id, participant, min(t) AS st, avg(value) AS view FROM s WHERE event_type = 'view' GROUP BY ALL),
e AS (SELECT group_id, task_id, participant, min(t) AS st, avg(value) AS error FROM s WHERE event_type = 'error' GROUP BY ALL)
SELECT group_id, task_id, participant, round(coalesce(c.st, v.st, e.st), 3) AS window_start, round(click, 6) AS click, round(view, 6) AS view, round(error, 6) AS error
FROM c FULL JOIN v USING (group_id, task_id, participant) FULL JOIN e USING (group_id, task_id, participant)""")
def _(spark, sf):
    s, keys = samples(spark, sf), ["group_id", "task_id", "participant"]
    one = lambda k: s.filter(F.col("event_type") == k).groupBy(*keys).agg(F.min("t").alias("window_start"), F.avg("value").alias(k))
    j = joins.join_modalities([one("click"), one("view"), one("error")], keys, ["window_start"])
    return rounded(j.withColumn("window_start", F.round("window_start", 3)))


@query("enrichment_chain", """
SELECT o_orderkey, o_totalprice, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = joins.enrich(o, (c, ["c_custkey"]), (n, ["n_nationkey"]), (table(spark, sf, "region"), ["r_regionkey"]))
    return out.select("o_orderkey", "o_totalprice", "c_mktsegment", "n_name", "r_name")


@query("complete_cases", """
SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 100 AND o_totalprice > 5000""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), X.in_range("o_totalprice", 5000.0000001).alias("o_totalprice"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), X.in_range("c_acctbal", 100.0000001).alias("c_acctbal"))
    return joins.complete_cases(o, c, ["k"], ["o_totalprice", "c_acctbal"]).drop("k")


@query("many_to_one_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.many_to_one(c, table(spark, sf, "nation"), ["n_nationkey"]).select("c_custkey", "n_name")


@query("expected_grid", "WITH " + SAMPLES + """, a AS (SELECT group_id, task_id, participant, count(*) AS n FROM s WHERE value > 40 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT group_id FROM s), (SELECT unnest(['T0','T1','T2','T3','T4','T5']) AS task_id), (SELECT unnest(['P1','P2','P3','P4']) AS participant))
SELECT group_id, task_id, participant, coalesce(n, 0) AS n, n IS NULL AS missing FROM g LEFT JOIN a USING (group_id, task_id, participant)""")
def _(spark, sf):
    s, keys = samples(spark, sf), ["group_id", "task_id", "participant"]
    grid = joins.expected_grid(s.select("group_id"), {"task_id": ["T0", "T1", "T2", "T3", "T4", "T5"], "participant": ["P1", "P2", "P3", "P4"]})
    return joins.against_expected(grid, s.filter("value > 40").groupBy(*keys).agg(F.count("*").alias("n")), keys, {"n": 0})


@query("member_pairs", "WITH " + SAMPLES + """, m AS (SELECT DISTINCT group_id, task_id, participant FROM s)
SELECT x.group_id, x.task_id, x.participant AS a, y.participant AS b FROM m x JOIN m y ON x.group_id = y.group_id AND x.task_id = y.task_id AND x.participant < y.participant""")
def _(spark, sf):
    return signals.dyads(samples(spark, sf), ["group_id", "task_id"], "participant")


_SEG = "WITH " + ANNOTATIONS + """, sp AS (SELECT event_id AS sid, group_id, task_id, speaker, onset, onset + duration * 20 AS "end" FROM ann WHERE type = 'SPK'),
ev AS (SELECT event_id, group_id, task_id, speaker, onset, onset + duration * 20 AS "end" FROM ann WHERE type = 'OVL'),
"""


def _segments(spark, sf, kind):
    a = annotations(spark, sf).filter(F.col("type") == kind)
    return a.select("event_id", "group_id", "task_id", "speaker", "onset", (F.col("onset") + F.col("duration") * 20).alias("end"), "duration")


@query("overlap_pairs", _SEG + """p AS (SELECT ev.event_id, sid, least(ev."end", sp."end") - greatest(ev.onset, sp.onset) AS s FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND ev.onset < sp."end" AND sp.onset < ev."end")
SELECT event_id, sid, round(s, 4) AS seconds FROM p""")
def _(spark, sf):
    p = intervals.overlap_join(_segments(spark, sf, "OVL"), _segments(spark, sf, "SPK"), ["group_id", "task_id"], ("onset", "end"), ("onset", "end"), 14400.0)
    s = F.least("end", "r_end") - F.greatest("onset", "r_onset")
    return p.select("event_id", F.col("r_event_id").alias("sid"), F.round(s, 4).alias("seconds"))


@query("surrounding_segments", _SEG + """ov AS (SELECT ev.event_id, sid, row_number() OVER (PARTITION BY ev.event_id ORDER BY sp.onset) AS rn FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND ev.onset < sp."end" AND sp.onset < ev."end"),
er AS (SELECT ev.event_id, sid, row_number() OVER (PARTITION BY ev.event_id ORDER BY sp.onset DESC) AS rn FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND sp.onset < ev.onset),
k AS (SELECT event_id, max(sid) FILTER (rn = 1) AS o1, max(sid) FILTER (rn = 2) AS o2 FROM ov GROUP BY 1),
q AS (SELECT event_id, max(sid) FILTER (rn = 1) AS e1, max(sid) FILTER (rn = 2) AS e2 FROM er GROUP BY 1)
SELECT event_id, CASE WHEN o2 IS NOT NULL THEN o1 WHEN o1 IS NOT NULL THEN coalesce(e1, o1) WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e2 END AS a,
       CASE WHEN o2 IS NOT NULL THEN o2 WHEN o1 IS NOT NULL THEN CASE WHEN e1 IS NOT NULL THEN o1 END WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e1 END AS b
FROM ev LEFT JOIN k USING (event_id) LEFT JOIN q USING (event_id)""")
def _(spark, sf):
    seg = _segments(spark, sf, "SPK").withColumnRenamed("event_id", "sid")
    j = joins.surrounding_segments(_segments(spark, sf, "OVL"), seg, ["group_id", "task_id"], "event_id", "onset", "end", ["sid"])
    return j.select("event_id", F.col("seg_a.sid").alias("a"), F.col("seg_b.sid").alias("b"))


@query("follow_ups", "WITH " + SAMPLES + """
SELECT a.event_id AS first_id, b.event_id AS second_id, round(b.t - a.t, 5) AS gap FROM s a JOIN s b ON a.group_id = b.group_id AND a.participant <> b.participant
  AND b.t >= a.t AND b.t <= a.t + a.value + 3600 WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def _(spark, sf):
    s = samples(spark, sf).select("event_id", "group_id", "participant", "event_type", "t", (F.col("t") + F.col("value")).alias("z"))
    f = joins.follow_ups(s.filter("event_type = 'error'"), s.filter("event_type = 'click'"), ["group_id"], "t", "z", "participant", 3600.0, 3600.0)
    return f.select(F.col("event_id").alias("first_id"), F.col("b_event_id").alias("second_id"), F.round(F.col("b_t") - F.col("t"), 5).alias("gap"))


@query("nearest_sample", "WITH " + SAMPLES + """, c AS (SELECT event_id, user_id, t FROM s WHERE event_type = 'click'), v AS (SELECT user_id, t, value, event_id AS vid FROM s WHERE event_type = 'view'),
b AS (SELECT c.event_id, v.t AS bt, v.vid AS bv FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t),
f AS (SELECT c.event_id, v.t AS ft, v.vid AS fv FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t <= v.t)
SELECT c.event_id, CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR c.t - bt <= ft - c.t THEN bv ELSE fv END AS nearest_id,
       round(CASE WHEN bt IS NULL THEN ft WHEN ft IS NULL OR c.t - bt <= ft - c.t THEN bt ELSE ft END - c.t, 5) AS delta
FROM c JOIN b USING (event_id) JOIN f USING (event_id)""")
def _(spark, sf):
    s = samples(spark, sf)
    c = s.filter("event_type = 'click'").select("event_id", "user_id", "t")
    v = s.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("vid"))
    j = intervals.asof_join(c, v, ["user_id"], "t", "t", ["vid"], "nearest")
    return j.select("event_id", F.col("m_vid").alias("nearest_id"), F.round(F.col("m_t") - F.col("t"), 5).alias("delta"))


@query("resampled_grid", "WITH " + SAMPLES + """, sp AS (SELECT user_id, min(t) AS a, max(t) AS z FROM s GROUP BY 1),
g AS (SELECT user_id, i AS grid_index, a + i * 43200.0::DOUBLE AS g FROM (SELECT user_id, a, unnest(range(0, CAST(floor((z - a) / 43200.0::DOUBLE) AS BIGINT) + 1)) AS i FROM sp)),
b AS (SELECT g.user_id, grid_index, g, s.t AS bt, s.event_id AS be FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.g >= s.t),
f AS (SELECT g.user_id, grid_index, s.t AS ft, s.event_id AS fe FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.g <= s.t),
n AS (SELECT user_id, grid_index, g, CASE WHEN bt IS NULL THEN ft WHEN ft IS NULL OR g - bt <= ft - g THEN bt ELSE ft END AS nt, CASE WHEN bt IS NULL THEN fe WHEN ft IS NULL OR g - bt <= ft - g THEN be ELSE fe END AS ne FROM b JOIN f USING (user_id, grid_index))
SELECT user_id, grid_index, CASE WHEN abs(nt - g) <= 10800 THEN ne END AS event_id, coalesce(abs(nt - g) > 10800, true) AS is_missing FROM n""")
def _(spark, sf):
    g = joins.resample_grid(samples(spark, sf).select("user_id", "t", "event_id"), ["user_id"], "t", ["event_id"], 43200.0, 10800.0)
    return g.select("user_id", "grid_index", F.col("m_event_id").alias("event_id"), "is_missing")


_RANGES = ", w AS (SELECT group_id, task_id AS task, min(t) + 3600 AS a, max(t) - 3600 AS z FROM s WHERE event_type = 'view' GROUP BY 1, 2)"


def _ranges(s):
    return s.filter("event_type = 'view'").groupBy("group_id", F.col("task_id").alias("task")).agg((F.min("t") + 3600).alias("a"), (F.max("t") - 3600).alias("z"))


@query("samples_in_windows", "WITH " + SAMPLES + _RANGES + """
SELECT w.group_id, task, count(*) AS n, round(avg(value), 6) AS mean FROM s JOIN w ON s.group_id = w.group_id AND t >= a AND t < z GROUP BY 1, 2""")
def _(spark, sf):
    s = samples(spark, sf)
    j = intervals.within_join(s.select("group_id", "t", "value"), _ranges(s), ["group_id"], "t", ("a", "z"), 86400.0)
    return rounded(j.groupBy("group_id", "task").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("phase_lookup", "WITH " + SAMPLES + _RANGES + """
SELECT event_id, task FROM s LEFT JOIN w ON s.group_id = w.group_id AND t >= a AND t <= z""")
def _(spark, sf):
    s = samples(spark, sf)
    j = intervals.within_join(s.select("event_id", "group_id", "t"), _ranges(s), ["group_id"], "t", ("a", "z"), 86400.0, closed=True, how="left")
    return j.select("event_id", "task")


@query("context_text", "WITH " + TURNS + """
SELECT a.conv_id, a.turn, string_agg(b.speaker || CAST(b.turn AS VARCHAR), ' | ' ORDER BY b.onset) AS context, count(*) AS n_segments
FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.onset - 5 < b."end" AND b.onset < a."end" + 5 GROUP BY 1, 2""")
def _(spark, sf):
    u = turns(spark, sf).withColumn("who", F.concat("speaker", F.col("turn").cast("string")))
    return joins.context_text(u, u, ["conv_id"], "turn", "onset", "end", "who", 5.0, 30.0)


@query("uncovered_short_tokens", "WITH " + ANNOTATIONS + """, sp AS (SELECT group_id, task_id, speaker, onset, onset + duration * 60 AS z FROM ann WHERE type = 'SPK'), b AS (SELECT *, onset + duration AS z FROM ann WHERE type = 'BCK')
SELECT event_id FROM b WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.group_id = b.group_id AND sp.task_id = b.task_id AND sp.speaker = b.speaker AND b.onset < sp.z AND sp.onset < b.z)""")
def _(spark, sf):
    a = annotations(spark, sf).select("event_id", "group_id", "task_id", "speaker", "type", "onset", "duration")
    sp = a.filter("type = 'SPK'").withColumn("z", F.col("onset") + F.col("duration") * 60)
    b = a.filter("type = 'BCK'").withColumn("z", F.col("onset") + F.col("duration"))
    return intervals.overlap_join(b, sp, ["group_id", "task_id", "speaker"], ("onset", "z"), ("onset", "z"), 14400.0, how="left_anti").select("event_id")


@query("membership_filter", "SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rounded(table(spark, sf, "orders").join(c, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")))


@query("piecewise_clock", "WITH " + SAMPLES + """, g AS (SELECT user_id, t AS t0, 1 + value / 1e6 AS scale, value AS off FROM s WHERE event_type = 'signup'),
f AS (SELECT user_id, arg_min(scale, t0) AS fs, arg_min(off, t0) AS fo FROM g GROUP BY 1),
a AS (SELECT s.event_id, s.user_id, s.t, g.scale, g.off FROM s ASOF LEFT JOIN g ON s.user_id = g.user_id AND s.t >= g.t0)
SELECT event_id, round(coalesce(scale, fs) * t + coalesce(off, fo), 2) AS mapped FROM a LEFT JOIN f USING (user_id)""")
def _(spark, sf):
    s = samples(spark, sf)
    seg = s.filter("event_type = 'signup'").select("user_id", F.col("t").alias("t0"), (1 + F.col("value") / 1e6).alias("scale"), F.col("value").alias("offset"))
    m = joins.piecewise_clock(s.select("event_id", "user_id", "t"), seg, ["user_id"], "t", "mapped")
    return rounded(m.select("event_id", "mapped"), 2)


_NAMES = """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN left(p_name, length(p_name) - 1) WHEN p_partkey % 4 = 2 THEN replace(p_name, 'e', 'xx') ELSE p_name END AS nm FROM part),
k AS (SELECT p_partkey, trim(regexp_replace(lower(nm), '\\s+', ' ', 'g')) AS a FROM n),
c AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS b FROM part),
d AS (SELECT DISTINCT a FROM k), p AS (SELECT a, b, 1 - levenshtein(a, b) * 1.0::DOUBLE / greatest(length(a), length(b)) AS r FROM d, c WHERE length(a) > 0),
m AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rn, r FROM p WHERE r >= 0.8 - 1e-9)
"""


@query("crosswalk", _NAMES + "SELECT p_partkey, coalesce(b, 'n/a') AS matched, CASE WHEN b = k.a THEN 'exact' WHEN b IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS outcome FROM k LEFT JOIN m ON k.a = m.a AND rn = 1")
def _(spark, sf):
    return joins.crosswalk(*_broken_names(spark, sf), 0.8).select("p_partkey", "matched", "outcome")


def _broken_names(spark, sf):
    """Part names with letter case, an end or some letters changed, and the names as they were."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey") % 4
    broken = (F.when(k == 0, F.upper("p_name")).when(k == 1, F.substr(F.col("p_name"), F.lit(1), F.length("p_name") - 1))
              .when(k == 2, F.replace(F.col("p_name"), F.lit("e"), F.lit("xx"))).otherwise(F.col("p_name")))
    return p.select("p_partkey", broken.alias("nm")), "nm", p, "p_name"


_BLOCKS = _NAMES.replace("WITH n AS", "WITH RECURSIVE n AS").split("p AS (SELECT a, b, 1 -")[0] + """q AS (SELECT a, b FROM d, c WHERE length(a) > 0 AND a NOT IN (SELECT b FROM c)),
seg AS (SELECT a, b, 1::BIGINT AS al, length(a) + 1 AS ah, 1::BIGINT AS bl, length(b) + 1 AS bh, 0::BIGINT AS m FROM q
  UNION ALL SELECT a, b, CASE WHEN side = 0 THEN al ELSE i + k END, CASE WHEN side = 0 THEN i ELSE ah END, CASE WHEN side = 0 THEN bl ELSE j + k END, CASE WHEN side = 0 THEN j ELSE bh END, CASE WHEN side = 0 THEN k ELSE 0 END
  FROM (SELECT * FROM (SELECT *, unnest(range(1, least(ah - i, bh - j) + 1)) AS k FROM (SELECT *, unnest(range(bl, bh)) AS j FROM (SELECT *, unnest(range(al, ah)) AS i FROM seg)))
        WHERE substring(a, i, k) = substring(b, j, k) QUALIFY row_number() OVER (PARTITION BY a, b, al, ah, bl, bh ORDER BY k DESC, j, i) = 1), (VALUES (0), (1)) v(side)),
r AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS r FROM seg GROUP BY a, b HAVING r >= 0.75 - 1e-9),
m AS (SELECT a, b FROM r QUALIFY row_number() OVER (PARTITION BY a ORDER BY r DESC, b DESC) = 1 UNION ALL SELECT b, b FROM c)
"""


@query("crosswalk_blocks", _BLOCKS + "SELECT p_partkey, coalesce(b, 'n/a') AS matched, CASE WHEN b = k.a THEN 'exact' WHEN b IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS outcome FROM k LEFT JOIN m ON k.a = m.a")
def _(spark, sf):
    return joins.crosswalk(*_broken_names(spark, sf), 0.75, blocks=True).select("p_partkey", "matched", "outcome")


@query("crosswalk_outcomes", _BLOCKS + "SELECT count(*) FILTER (b = k.a) AS n_exact, count(*) FILTER (b <> k.a) AS n_fuzzy, count(*) FILTER (b IS NULL) AS n_none FROM k LEFT JOIN m ON k.a = m.a")
def _(spark, sf):
    return joins.outcome_counts(joins.crosswalk(*_broken_names(spark, sf), 0.75, blocks=True))


@query("focal_vs_others", """
WITH a AS (SELECT c_custkey, c_acctbal, count(*) OVER w - 1 AS n, sum(c_acctbal) OVER w - c_acctbal AS s, sum(c_acctbal**2) OVER w - c_acctbal**2 AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey))
SELECT c_custkey, n AS others_n, CASE WHEN n > 0 THEN round(s / n, 6) END AS others_mean, CASE WHEN n > 0 THEN round(sqrt(greatest(q / n - (s / n)**2, 0)), 6) END AS others_sd FROM a""")
def _(spark, sf):
    f = groups.focal_vs_others(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
    return rounded(f.select("c_custkey", "others_n", "others_mean", "others_sd"))


@query("peer_mean", """
SELECT c_nationkey, o_custkey % 10 AS rated, round(avg(o_totalprice), 6) AS peer_mean, count(*) AS n_ratings FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_custkey % 10 <> o_orderkey % 10 GROUP BY 1, 2""")
def _(spark, sf):
    r = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    r = r.withColumns({"rated": F.col("o_custkey") % 10, "rater": F.col("o_orderkey") % 10})
    return rounded(joins.peer_mean(r, ["c_nationkey"], "rater", "rated", "o_totalprice"))


@query("covered_by_others", "WITH " + ANNOTATIONS + """, sg AS (SELECT event_id, group_id, task_id, speaker, onset AS a, onset + duration * 60 AS z FROM ann WHERE type IN ('SPK', 'BCK')),
j AS (SELECT x.event_id, greatest(x.a, y.a) AS a, least(x.z, y.z) AS z FROM sg x JOIN sg y ON x.group_id = y.group_id AND x.task_id = y.task_id AND x.speaker <> y.speaker AND x.a < y.z AND y.a < x.z),
o AS (SELECT *, max(z) OVER (PARTITION BY event_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM j),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS isl FROM o),
m AS (SELECT event_id, max(z) - min(a) AS len FROM i GROUP BY event_id, isl)
SELECT event_id, round(sum(len), 3) AS covered_s FROM m GROUP BY 1""")
def _(spark, sf):
    a = annotations(spark, sf).filter(F.col("type").isin("SPK", "BCK")).select(
        "event_id", "group_id", "task_id", "speaker", F.col("onset").alias("a"), (F.col("onset") + F.col("duration") * 60).alias("z"))
    c = intervals.covered_seconds(a, a, ["group_id", "task_id"], "event_id", ("a", "z"), "speaker", points=True)
    return rounded(c.select("event_id", "covered_s"), 3)


@query("cross_member_similarity", """
WITH e AS (SELECT vec_id, label, vec_id % 4 AS spk, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND a.spk <> b.spk GROUP BY 1""")
def _(spark, sf):
    e = vectors(spark, sf).withColumn("spk", F.col("vec_id") % 4)
    return rounded(joins.cross_member_similarity(e, ["label"], "spk", "embedding"))


@query("best_shift", """
WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(o_orderdate) / 1e6 + 40000.0 AS z FROM orders),
l AS (SELECT l_orderkey AS k, epoch_us(min(l_shipdate)) / 1e6 AS b, epoch_us(min(l_shipdate)) / 1e6 + 50000.0 AS y FROM lineitem GROUP BY 1),
c AS (SELECT k, s, greatest(0, least(z, y + s * 86400.0::DOUBLE) - greatest(a, b + s * 86400.0::DOUBLE)) AS ov FROM o JOIN l USING (k), (SELECT unnest(range(-14, 15)) AS s))
SELECT k, s AS shift, ov AS overlap FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY ov DESC, abs(s), s) = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), X.epoch_seconds("o_orderdate").alias("a"), (X.epoch_seconds("o_orderdate") + 40000.0).alias("z"))
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("d"))
    l = l.select("k", X.epoch_seconds("d").alias("b"), (X.epoch_seconds("d") + 50000.0).alias("y"))
    out = joins.best_shift(o.join(l, "k"), ("a", "z"), ("b", "y"), range(-14, 15), 86400.0)
    return out.select("k", F.col("shift").cast("long").alias("shift"), "overlap")


@query("reconcile", """
WITH a AS (SELECT o_orderkey AS k, string_agg(DISTINCT o_orderstatus, ',') AS v FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1),
b AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'RIGHT_ONLY' WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.v = b.v THEN 'OK' ELSE 'DIFF' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    b = table(spark, sf, "lineitem").filter("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return joins.reconcile(a, b, ["k"], "v", ",").select("k", "status")
