"""Queries over row-level cleaning, gating and labelling."""

from pyspark.sql import functions as F

from gatherline.functions import exprs as X
from gatherline.operators import clean, groups
from gatherline.plans.bindings import SAMPLES, TURNS, samples, turns
from gatherline.plans.registry import query, rounded, table


@query("range_clean", """
SELECT event_id, CASE WHEN value BETWEEN 5 AND 300 AND abs(value) < 250 THEN value END AS value FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.in_range("value", 5, 300, 250).alias("value"))


@query("plausibility_gate", """
SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 300000 THEN o_totalprice END AS o_totalprice,
       CASE WHEN o_custkey BETWEEN 10 AND 1000 THEN o_custkey END AS o_custkey FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    g = clean.plausibility_gate(o, {"o_totalprice": (1000.0, 300000.0), "o_custkey": (10.0, 1000.0)})
    return g.withColumn("o_custkey", F.col("o_custkey").cast("long"))


@query("quality_gate", "WITH " + SAMPLES + """, w AS (
  SELECT user_id, task_id, count(*) AS n, count(CASE WHEN value >= 40 THEN 1 END) AS n_ok, avg(CASE WHEN value >= 40 THEN value END) AS m,
         max(CASE WHEN value >= 40 THEN value END) AS mx FROM s GROUP BY 1, 2)
SELECT user_id, task_id, round(1 - n_ok * 1.0 / n, 6) AS missing_frac,
       CASE WHEN 1 - n_ok * 1.0::DOUBLE / n <= 0.5 THEN round(m, 6) END AS m, CASE WHEN 1 - n_ok * 1.0::DOUBLE / n <= 0.5 THEN mx END AS mx FROM w""")
def _(spark, sf):
    v = X.in_range("value", 40)
    w = samples(spark, sf).groupBy("user_id", "task_id").agg(
        (1 - F.count(v) / F.count("*")).alias("missing_frac"), F.avg(v).alias("m"), F.max(v).alias("mx"))
    return rounded(clean.quality_gate(w, F.col("missing_frac") <= 0.5, ["m", "mx"]))


@query("winsorise", """
WITH st AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS dq FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, m - 1.5 * d), m + 1.5 * d), 4) AS l_extendedprice,
       round(least(greatest(l_quantity, mq - 1.5 * dq), mq + 1.5 * dq), 4) AS l_quantity FROM lineitem, st""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(groups.winsorise(li, ["l_extendedprice", "l_quantity"], 1.5), 4)


@query("threshold_labels", """
SELECT event_id, CASE WHEN (value - 100) / 50 >= 1 THEN 'High' WHEN (value - 100) / 50 <= -1 THEN 'Low' ELSE 'Moderate' END AS score_label,
       CASE WHEN value / 10 >= 7 THEN 'High' WHEN value / 10 <= 3 THEN 'Low' ELSE 'Moderate' END AS rating_label FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", X.score_label((F.col("value") - 100) / 50).alias("score_label"),
        X.score_label(F.col("value") / 10, 7.0, 3.0).alias("rating_label"))


@query("phase_filter", "WITH " + TURNS + """, o AS (
  SELECT conv_id, min(onset) AS first_user FROM u WHERE speaker = 'user' AND conv_id % 5 <> 0 GROUP BY 1)
SELECT conv_id, turn, round(onset, 6) AS onset FROM u LEFT JOIN o USING (conv_id) WHERE first_user IS NULL OR onset >= first_user""")
def _(spark, sf):
    u = turns(spark, sf)
    timing = u.filter((F.col("speaker") == "user") & (F.col("conv_id") % 5 != 0))
    return rounded(clean.phase_filter(u, timing, ["conv_id"], "onset", "onset").select("conv_id", "turn", "onset"))


@query("speaker_predicates", "WITH " + TURNS + """
SELECT conv_id, count(*) FILTER (speaker LIKE 'user%') AS n_user, count(*) FILTER (speaker LIKE 'assist%') AS n_assistant,
       round(coalesce(sum(duration) FILTER (speaker LIKE 'user%'), 0), 6) AS user_s FROM u GROUP BY conv_id""")
def _(spark, sf):
    is_user = F.col("speaker").startswith("user")
    return rounded(turns(spark, sf).groupBy("conv_id").agg(
        F.count_if(is_user).alias("n_user"), F.count_if(F.col("speaker").startswith("assist")).alias("n_assistant"),
        F.coalesce(F.sum(F.when(is_user, F.col("duration"))), F.lit(0.0)).alias("user_s")))


@query("active_span_trim", "WITH " + SAMPLES + """, w AS (
  SELECT user_id, day(ts) AS d, count(*) AS n, max(value) AS top FROM s GROUP BY 1, 2),
sp AS (SELECT user_id, min(d) AS a, max(d) AS z FROM w WHERE top >= 60 GROUP BY 1)
SELECT user_id, w.d AS d, n FROM w JOIN sp USING (user_id) WHERE w.d BETWEEN a AND z""")
def _(spark, sf):
    w = samples(spark, sf).groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(
        F.count("*").alias("n"), F.max("value").alias("top"))
    return clean.trim_to_active(w, ["user_id"], "d", F.col("top") >= 60).select("user_id", "d", "n")


@query("pair_mean", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.02 AND l_tax > 0.02 THEN (l_discount + l_tax) / 2
       WHEN l_discount > 0.02 THEN l_discount WHEN l_tax > 0.02 THEN l_tax END, 6) AS both_eyes FROM lineitem""")
def _(spark, sf):
    left, right = X.in_range("l_discount", 0.0200001), X.in_range("l_tax", 0.0200001)
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.pair_mean(left, right).alias("both_eyes")))


@query("row_mean", """
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, CASE WHEN c_nationkey > 5 THEN c_nationkey * 100.0::DOUBLE END AS b,
                  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1.0::DOUBLE END AS d FROM customer),
p AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT AS n, coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0) AS t FROM c)
SELECT c_custkey, CASE WHEN n >= 1 THEN round(t / n, 6) END AS any_part, CASE WHEN n >= 2 THEN round(t / n, 6) END AS two_parts FROM p""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    parts = [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") * 100.0),
             F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 1.0)]
    return rounded(c.select("c_custkey", X.row_mean(parts).alias("any_part"), X.row_mean(parts, 2).alias("two_parts")))


_SIG = ["click", "view", "error", "signup", "purchase"]
_SIGNALS = {"eda": "click", "scr": "view", "rate": "error", "rmssd": "signup", "pupil": "purchase", "pupil_sd": "spread", "missing": "low", "valid": "high"}
_SIG_SQL = "WITH " + SAMPLES + """, w AS (
  SELECT user_id, task_id, avg(value) FILTER (event_type='click') AS click, avg(value) FILTER (event_type='view') AS view,
         avg(value) FILTER (event_type='error') AS error, avg(value) FILTER (event_type='signup') AS signup,
         avg(value) FILTER (event_type='purchase') AS purchase, stddev_pop(value) AS spread,
         avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0 END) AS low, avg(CASE WHEN value > 80 THEN 1.0::DOUBLE ELSE 0 END) AS high
  FROM s GROUP BY 1, 2),
l AS (SELECT user_id, task_id, f, v FROM (UNPIVOT w ON click, view, error, signup, purchase, spread, low, high INTO NAME f VALUE v)),
"""
_PIV = """pv AS (SELECT user_id, task_id, max(z) FILTER (f='click') AS eda, max(z) FILTER (f='view') AS scr, max(z) FILTER (f='error') AS rate,
  max(z) FILTER (f='signup') AS rmssd, max(z) FILTER (f='purchase') AS pupil, max(z) FILTER (f='spread') AS psd,
  max(z) FILTER (f='low') AS miss, max(z) FILTER (f='high') AS ok FROM q GROUP BY 1, 2),
c AS (SELECT user_id, task_id, pupil, list_avg([x FOR x IN [pupil, eda, -rmssd] IF x IS NOT NULL]) AS cognitive_load,
  list_avg([x FOR x IN [scr, rate, psd] IF x IS NOT NULL]) AS arousal, list_avg([x FOR x IN [ok, -miss, -psd] IF x IS NOT NULL]) AS attention,
  list_avg([x FOR x IN [-eda, -rate, rmssd] IF x IS NOT NULL]) AS recovery, eda FROM pv)
SELECT user_id, task_id, round(cognitive_load, 5) AS cognitive_load, round(arousal, 5) AS arousal, round(attention, 5) AS attention,
  round(list_avg([x FOR x IN [arousal, eda] IF x IS NOT NULL]), 5) AS pressure"""


def _signals(spark, sf):
    one = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in _SIG]
    return samples(spark, sf).groupBy("user_id", "task_id").agg(
        *one, F.stddev_pop("value").alias("spread"), F.avg((F.col("value") < 20).cast("double")).alias("low"),
        F.avg((F.col("value") > 80).cast("double")).alias("high"))


@query("biomarker_composites", _SIG_SQL + """b AS (SELECT user_id, f, max(v) FILTER (task_id = 'T0') AS b, avg(v) AS m, stddev_samp(v) AS d FROM l GROUP BY 1, 2),
q AS (SELECT l.user_id, task_id, l.f, CASE WHEN d > 0 THEN (v - coalesce(b, m)) / d ELSE 0.0 END AS z FROM l JOIN b ON l.user_id = b.user_id AND l.f = b.f),
""" + _PIV + """, round(recovery, 5) AS recovery,
  CASE WHEN task_id <> 'T0' THEN round(CAST(substr(task_id, 2) AS INT) * (-pupil) / 4.0, 5) END AS fatigue,
  CASE WHEN cognitive_load >= 1 THEN 'High' WHEN cognitive_load <= -1 THEN 'Low' WHEN cognitive_load IS NOT NULL THEN 'Moderate' ELSE 'Unknown' END AS load_label,
  CASE WHEN arousal >= 1 THEN 'High' WHEN arousal <= -1 THEN 'Low' WHEN arousal IS NOT NULL THEN 'Moderate' ELSE 'Unknown' END AS arousal_label FROM c""")
def _(spark, sf):
    d = clean.composites(_signals(spark, sf), ["user_id"], "task_id", _SIGNALS)
    return rounded(d.select("user_id", "task_id", "cognitive_load", "arousal", "attention", "pressure", "recovery", "fatigue", "load_label", "arousal_label"), 5)


@query("biomarker_composites_window", _SIG_SQL + """b AS (SELECT user_id, f, avg(v) AS m, stddev_samp(v) AS d FROM l GROUP BY 1, 2),
q AS (SELECT l.user_id, task_id, l.f, CASE WHEN d > 0 THEN (v - m) / d ELSE 0.0 END AS z FROM l JOIN b ON l.user_id = b.user_id AND l.f = b.f),
""" + _PIV + " FROM c")
def _(spark, sf):
    d = clean.composites(_signals(spark, sf), ["user_id"], "task_id", _SIGNALS, within=["user_id"])
    return rounded(d.select("user_id", "task_id", "cognitive_load", "arousal", "attention", "pressure"), 5)


@query("qc_flags", "WITH " + SAMPLES + """, w AS (
  SELECT user_id, task_id, count(*) AS n, avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0 END) AS low, stddev_samp(value) AS sd, max(value) AS mx FROM s GROUP BY 1, 2)
SELECT user_id, task_id, array_to_string([x FOR x IN [CASE WHEN n < 8 THEN 'few_samples' END, CASE WHEN low > 0.3 THEN 'low_signal' END,
  CASE WHEN sd IS NULL OR sd < 20 THEN 'flat_signal' END, CASE WHEN mx > 200 THEN 'spike' END] IF x IS NOT NULL], ';') AS qc_flags,
  CASE WHEN n < 8 THEN 'exclude' WHEN low > 0.3 THEN 'review' ELSE 'use' END AS handling FROM w""")
def _(spark, sf):
    w = samples(spark, sf).groupBy("user_id", "task_id").agg(
        F.count("*").alias("n"), F.avg((F.col("value") < 20).cast("double")).alias("low"), F.stddev_samp("value").alias("sd"), F.max("value").alias("mx"))
    flags = X.flag_text({"few_samples": F.col("n") < 8, "low_signal": F.col("low") > 0.3,
                         "flat_signal": F.col("sd").isNull() | (F.col("sd") < 20), "spike": F.col("mx") > 200})
    handling = X.first_match([(F.col("n") < 8, "exclude"), (F.col("low") > 0.3, "review")], "use")
    return w.select("user_id", "task_id", flags.alias("qc_flags"), handling.alias("handling"))


@query("priority_status", """
SELECT p_partkey, CASE WHEN p_size >= 40 AND p_retailprice < 950 THEN 'critical' WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'medium' ELSE 'low' END AS status FROM part""")
def _(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", X.first_match(
        [((size >= 40) & (F.col("p_retailprice") < 950), "critical"), (size >= 40, "high"), (size >= 20, "medium")], "low").alias("status"))


@query("log_counts", "SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(l_quantity - 10, 0)), 6) AS log_q FROM lineitem")
def _(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.log_count(F.col("l_quantity") - 10).alias("log_q")))


@query("one_hot", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0 END AS p_1, CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0 END AS p_2,
       CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0 END AS p_5 FROM orders""")
def _(spark, sf):
    o = clean.one_hot(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "p")
    return o.select("o_orderkey", F.col("`p_1-URGENT`").alias("p_1"), F.col("`p_2-HIGH`").alias("p_2"), F.col("`p_5-LOW`").alias("p_5"))


@query("melt", """
SELECT c_custkey, 'c_acctbal' AS feature, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return clean.melt(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("pivot", """
SELECT o_custkey, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "O",
       round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS "P" FROM orders GROUP BY 1""")
def _(spark, sf):
    return rounded(clean.widen(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.avg("o_totalprice")))


@query("loose_boolean", "SELECT doc_id, coalesce(toxic = 1, false) AS toxic, doc_id % 3 = 0 AS yes FROM labels")
def _(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, " Yes ").when(F.col("doc_id") % 3 == 1, "no")
    return table(spark, sf, "labels").select("doc_id", X.loose_bool("toxic").alias("toxic"), X.loose_bool(text).alias("yes"))


@query("privacy_view", "SELECT sha256('k7' || CAST(c_custkey AS VARCHAR)) AS person, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return clean.privacy_view(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], {"c_custkey": "person"}, "k7")


@query("reason_gate", """
SELECT l_returnflag, count(*) FILTER (l_quantity < 5) AS n_confidence, count(*) FILTER (l_discount > 0.08) AS n_error, count(*) FILTER (l_linenumber > 6) AS n_views,
       count(*) AS n_rows, count(*) FILTER (NOT (l_quantity < 5 OR l_discount > 0.08 OR l_linenumber > 6)) AS n_kept FROM lineitem GROUP BY 1""")
def _(spark, sf):
    g = clean.reason_gate(table(spark, sf, "lineitem"), {
        "confidence": F.col("l_quantity") < 5, "error": F.col("l_discount") > 0.08, "views": F.col("l_linenumber") > 6}, ["l_extendedprice"])
    counts = clean.reason_counts(g, ["confidence", "error", "views"], ["l_returnflag"])
    return counts.join(g.groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n_kept")), "l_returnflag")


@query("min_max_scale", """
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS scaled FROM part""")
def _(spark, sf):
    return rounded(groups.min_max(table(spark, sf, "part"), "p_retailprice", "scaled").select("p_partkey", "scaled"))


@query("median_split_profile", """
WITH m AS (SELECT median(c_acctbal) AS med FROM customer), s AS (SELECT *, CASE WHEN c_acctbal >= med THEN 'high' ELSE 'low' END AS side FROM customer, m)
SELECT side, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem FROM s GROUP BY 1, 2""")
def _(spark, sf):
    s = groups.median_split(table(spark, sf, "customer"), "c_acctbal", "side")
    return rounded(s.groupBy("side", "c_mktsegment").agg(
        F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("sem")))


_JOINTS = ("nose", "mid_hip", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow", "l_wrist", "r_wrist")


def _dist(i, j):
    return "sqrt(" + " + ".join(f"(x[{3 * i + k}] - x[{3 * j + k}])**2" for k in (1, 2, 3)) + ")"


def _side(name, sh, el, wr):
    ok = f"(1 - abs(x[{sh + 41}]) >= 0.85 AND 1 - abs(x[{el + 41}]) >= 0.85 AND 1 - abs(x[{wr + 41}]) >= 0.85)"
    path = f"({_dist(sh, el)} + {_dist(el, wr)})"
    return (f"{ok} AND {_dist(wr, 0)} <= 0.2 AS {name}_hand_to_head, {ok} AND {_dist(wr, 1)} <= 0.25 AS {name}_hand_to_chest, "
            f"{ok} AND {path} > 1e-6 AND {_dist(sh, wr)} / {path} >= 0.6 AS {name}_arm_extended")


@query("gesture_flags", f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, label, {_side('left', 2, 4, 6)}, {_side('right', 3, 5, 7)} FROM v)
SELECT *, left_hand_to_head AND right_hand_to_head AS both_hands_to_head FROM g""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    joints = F.array(*[
        F.struct(F.lit(j).alias("joint"), at(3 * i).alias("x"), at(3 * i + 1).alias("y"), at(3 * i + 2).alias("z"), (1 - F.abs(at(40 + i))).alias("conf"))
        for i, j in enumerate(_JOINTS)])
    long = e.select("vec_id", "label", F.explode(joints).alias("j")).select("vec_id", "label", "j.*")
    return clean.gesture_flags(long, ["vec_id", "label"], 0.85, 0.2, 0.25, 0.6)
