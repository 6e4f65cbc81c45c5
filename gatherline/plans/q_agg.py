"""Queries over interaction features and group aggregates."""

from pyspark.sql import functions as F

from gatherline.operators import groups, interaction, stats, windows
from gatherline.operators.ordered import top_row
from gatherline.plans.bindings import ANNOTATIONS, SAMPLES, TURNS, annotations, samples, turns
from gatherline.plans.registry import query, rounded, table

P4 = ["P1", "P2", "P3", "P4"]
GT = ["group_id", "task_id"]


@query("transcript_windows", "WITH " + ANNOTATIONS + """,
a AS (SELECT *, CASE WHEN subtype = 'needs_review' THEN CASE WHEN overlap_ms < 250 THEN 'backchannel_ovl' WHEN overlap_ms < 500 THEN 'smooth' WHEN overlap_ms < 1000 THEN 'competitive' ELSE 'floor_fight' END ELSE subtype END AS sub,
      CAST(floor(onset / 21600.0::DOUBLE) AS BIGINT) AS window_index FROM ann),
sp AS (SELECT group_id, task_id, min(onset) AS o0, max(onset + duration) AS o1 FROM a GROUP BY 1, 2),
g AS (SELECT group_id, task_id, unnest(range(CAST(greatest(floor((o0 - 7200.0::DOUBLE) / 21600.0::DOUBLE), 0) AS BIGINT), CAST(floor((o1 + 7200.0::DOUBLE) / 21600.0::DOUBLE) AS BIGINT) + 1)) AS window_index FROM sp),
b AS (SELECT group_id, task_id, window_index, count(*) FILTER (type = 'SPK') AS spk_count, round(coalesce(sum(duration) FILTER (type = 'SPK'), 0), 3) AS spk_duration_s,
  round(coalesce(sum(duration) FILTER (type = 'SIL'), 0), 3) AS silence_duration_s, count(*) FILTER (type = 'BCK') AS backchannel_count, count(*) FILTER (type = 'OVL') AS overlap_count,
  count(*) FILTER (type = 'OVL' AND sub IN ('competitive', 'floor_fight')) AS competitive_overlap, count(*) FILTER (type = 'OVL' AND (sub IN ('smooth', 'simultaneous', 'backchannel_ovl') OR context_label = 'collaborative')) AS cooperative_overlap,
  count(*) FILTER (type = 'OVL' AND context_label = 'collaborative') AS collaborative_overlap, count(*) FILTER (subtype = 'needs_review') AS needs_review_overlap,
  count(*) FILTER (type = 'LAU') AS laughter_count, count(*) FILTER (type = 'FP') AS filled_pause_count, round(coalesce(sum(overlap_ms) FILTER (type = 'SPK'), 0) / 1000, 3) AS overlap_time_s,
  count(DISTINCT speaker) FILTER (type = 'SPK') AS n_active_speakers FROM a GROUP BY 1, 2, 3),
d AS (SELECT group_id, task_id, window_index, speaker, sum(duration) AS w FROM a WHERE type = 'SPK' GROUP BY ALL),
e AS (SELECT group_id, task_id, window_index, -sum(w / t * log2(w / t)) AS speaking_entropy FROM (SELECT *, sum(w) OVER (PARTITION BY group_id, task_id, window_index) AS t FROM d) GROUP BY ALL),
o AS (SELECT * FROM a WHERE type = 'OVL' QUALIFY row_number() OVER (PARTITION BY group_id, task_id, window_index, round_even(onset * 100, 0) ORDER BY duration DESC, event_id) = 1),
k AS (SELECT group_id, task_id, window_index, count(*) AS ovl_count, round(sum(duration), 3) AS ovl_time_s, count(*) FILTER (sub = 'simultaneous') AS ovl_simultaneous, count(*) FILTER (sub = 'backchannel_ovl') AS ovl_backchannel,
  count(*) FILTER (sub = 'smooth') AS ovl_smooth, count(*) FILTER (sub = 'competitive') AS ovl_competitive_timing, count(*) FILTER (sub = 'floor_fight') AS ovl_floor_fight,
  count(*) FILTER (context_label = 'collaborative') AS ovl_ctx_collaborative, count(*) FILTER (context_label = 'completion') AS ovl_ctx_completion FROM o GROUP BY 1, 2, 3)
SELECT g.*, round(o0, 3) AS dialogue_onset_s, round(o1, 3) AS dialogue_offset_s, g.window_index * 21600.0::DOUBLE AS window_start_s, coalesce(spk_count, 0) AS spk_count, coalesce(spk_duration_s, 0) AS spk_duration_s,
  coalesce(silence_duration_s, 0) AS silence_duration_s, coalesce(backchannel_count, 0) AS backchannel_count, coalesce(overlap_count, 0) AS overlap_count, coalesce(competitive_overlap, 0) AS competitive_overlap,
  coalesce(cooperative_overlap, 0) AS cooperative_overlap, coalesce(collaborative_overlap, 0) AS collaborative_overlap, coalesce(needs_review_overlap, 0) AS needs_review_overlap, coalesce(laughter_count, 0) AS laughter_count,
  coalesce(filled_pause_count, 0) AS filled_pause_count, coalesce(overlap_time_s, 0) AS overlap_time_s, coalesce(n_active_speakers, 0) AS n_active_speakers, coalesce(round(speaking_entropy, 6), 0) AS speaking_entropy,
  coalesce(ovl_count, 0) AS ovl_count, coalesce(ovl_time_s, 0) AS ovl_time_s, coalesce(ovl_simultaneous, 0) AS ovl_simultaneous, coalesce(ovl_backchannel, 0) AS ovl_backchannel, coalesce(ovl_smooth, 0) AS ovl_smooth,
  coalesce(ovl_competitive_timing, 0) AS ovl_competitive_timing, coalesce(ovl_floor_fight, 0) AS ovl_floor_fight, coalesce(ovl_ctx_collaborative, 0) AS ovl_ctx_collaborative, coalesce(ovl_ctx_completion, 0) AS ovl_ctx_completion,
  CASE WHEN competitive_overlap + cooperative_overlap > 0 THEN round(competitive_overlap * 1.0::DOUBLE / (competitive_overlap + cooperative_overlap), 6) END AS conflict_overlap_ratio,
  CASE WHEN spk_count IS NOT NULL THEN round(coalesce(ovl_ctx_collaborative, 0) * 1.0::DOUBLE / greatest(coalesce(ovl_count, 0), 1), 6) END AS ovl_collaboration_index,
  CASE WHEN spk_count IS NOT NULL THEN round(coalesce(ovl_ctx_completion, 0) * 1.0::DOUBLE / greatest(coalesce(ovl_count, 0), 1), 6) END AS ovl_completion_index
FROM g LEFT JOIN b USING (group_id, task_id, window_index) LEFT JOIN e USING (group_id, task_id, window_index) LEFT JOIN k USING (group_id, task_id, window_index) JOIN sp USING (group_id, task_id)""")
def _(spark, sf):
    w = interaction.transcript_windows(annotations(spark, sf), GT, 21600.0, 7200.0, P4, 6, silent=True)
    return rounded(w.withColumns({c: F.round(c, 3) for c in ("dialogue_onset_s", "dialogue_offset_s")}))


@query("share_entropy", "WITH " + SAMPLES + """, d AS (SELECT user_id, event_type, sum(value) AS w FROM s GROUP BY 1, 2)
SELECT user_id, round(-sum(w / t * log2(w / t)), 6) AS entropy FROM (SELECT *, sum(w) OVER (PARTITION BY user_id) AS t FROM d) GROUP BY 1""")
def _(spark, sf):
    return rounded(groups.entropy_of_shares(samples(spark, sf), ["user_id"], ["event_type"], F.sum("value")))


@query("gini", """
WITH r AS (SELECT c_nationkey, greatest(c_acctbal, 0) AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM r GROUP BY 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("x", F.greatest("c_acctbal", F.lit(0.0)))
    return rounded(groups.gini(c, ["c_nationkey"], "x"))


@query("herfindahl", """
WITH d AS (SELECT l_suppkey, l_returnflag, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(sum(w * w) / sum(w)**2, 6) AS hhi FROM d GROUP BY 1""")
def _(spark, sf):
    return rounded(groups.herfindahl(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag"], F.sum("l_extendedprice")))


_RICH = ANNOTATIONS + """, rich AS (SELECT *, (event_id % 700 - 300) * 1.0::DOUBLE AS gap_prev_ms, (event_id % 500 - 100) * 1.0::DOUBLE AS trp_silence_ms,
  CASE WHEN event_id % 4 = 0 THEN -(event_id % 90) * 1.0::DOUBLE END AS interruption_gap_ms, (event_id % 350) * 1.0::DOUBLE AS bclatency_ms FROM ann)"""


def _rich(spark, sf):
    e = F.col("event_id")
    return annotations(spark, sf).withColumns({
        "gap_prev_ms": (e % 700 - 300).cast("double"), "trp_silence_ms": (e % 500 - 100).cast("double"),
        "interruption_gap_ms": F.when(e % 4 == 0, -(e % 90).cast("double")), "bclatency_ms": (e % 350).cast("double")})


@query("speaker_features", "WITH " + _RICH + """, td AS (SELECT group_id, task_id, max(onset + duration) - min(onset) AS d FROM ann GROUP BY 1, 2),
f AS (SELECT group_id, task_id, speaker, coalesce(sum(duration) FILTER (type='SPK'), 0) AS sp, count(*) FILTER (type='SPK') AS turn_count, avg(duration) FILTER (type='SPK') AS mt, stddev_samp(duration) FILTER (type='SPK') AS st,
  quantile_cont(duration, 0.5) FILTER (type='SPK') AS md, avg(gap_prev_ms) FILTER (type='SPK' AND gap_prev_ms > 0) AS gp, avg(trp_silence_ms) FILTER (type='SPK' AND trp_silence_ms > 0) AS tr,
  coalesce(sum(overlap_ms) FILTER (type='SPK'), 0) / 1000 AS ov, count(*) FILTER (type='SPK' AND interruption_gap_ms < 0) AS it, count(*) FILTER (type='BCK') AS bc, avg(bclatency_ms) FILTER (type='BCK') AS bl,
  count(*) FILTER (type='FP') AS fp, count(*) FILTER (type='BRE') AS br FROM rich GROUP BY 1, 2, 3)
SELECT group_id, task_id, speaker, round(sp, 5) AS speaking_time_s, turn_count, round(mt, 5) AS mean_turn_duration_s, round(st, 5) AS std_turn_duration_s, round(md, 5) AS median_turn_duration_s, round(gp, 5) AS mean_response_gap_ms,
  round(tr, 5) AS mean_trp_silence_ms, round(ov, 5) AS overlap_time_s, it AS interruption_count, bc AS backchannel_given_count, round(bl, 5) AS backchannel_latency_mean_ms, fp AS filled_pause_count, br AS breath_count,
  round(d, 3) AS task_duration_s, CASE WHEN d <> 0 THEN round(sp / d, 5) END AS speaking_share, CASE WHEN sp <> 0 THEN round(ov / sp, 5) END AS overlap_fraction, round(it / (d / 60), 5) AS interruption_rate_per_min,
  round(bc / (d / 60), 5) AS backchannel_given_rate_per_min, round(fp / (d / 60), 5) AS filled_pause_rate_per_min FROM f JOIN td USING (group_id, task_id)""")
def _(spark, sf):
    f = interaction.speaker_features(_rich(spark, sf), GT)
    return rounded(f.withColumn("task_duration_s", F.round("task_duration_s", 3)), 5)


@query("group_features", "WITH " + ANNOTATIONS + """, td AS (SELECT group_id, task_id, max(onset + duration) - min(onset) AS d FROM ann GROUP BY 1, 2),
f AS (SELECT group_id, task_id, count(DISTINCT speaker) FILTER (type='SPK') AS n_active_speakers, count(*) FILTER (type='SPK') AS total_turns, coalesce(sum(duration) FILTER (type='SIL'), 0) AS st, count(*) FILTER (type='SIL') AS sil_event_count,
  count(*) FILTER (type='LAU') AS laughter_count, coalesce(sum(duration) FILTER (type='LAU'), 0) AS lt, count(*) FILTER (type='OVL') AS overlap_event_count, count(*) FILTER (subtype IN ('competitive','floor_fight')) AS cc,
  count(*) FILTER (subtype IN ('smooth','simultaneous','backchannel_ovl')) AS co, count(*) FILTER (context_label = 'collaborative') AS cl, count(*) FILTER (subtype='needs_review') AS nr, count(*) FILTER (subtype='simultaneous') AS si,
  count(*) FILTER (subtype='backchannel_ovl') AS bo, count(*) FILTER (type <> 'SIL') AS act FROM ann GROUP BY 1, 2),
tr AS (SELECT group_id, task_id, speaker AS y, lag(speaker) OVER (PARTITION BY group_id, task_id ORDER BY onset, event_id) AS x FROM ann WHERE type = 'SPK'),
tc AS (SELECT group_id, task_id, x, y, count(*) AS n FROM tr WHERE x <> y GROUP BY ALL),
te AS (SELECT group_id, task_id, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY group_id, task_id) * 1.0::DOUBLE AS t FROM tc) GROUP BY 1, 2),
gr AS (SELECT group_id, task_id, p AS speaker FROM td, (SELECT unnest(['P1','P2','P3','P4']) AS p)),
sp AS (SELECT gr.group_id, gr.task_id, gr.speaker, coalesce(sum(duration), 0) AS x FROM gr LEFT JOIN ann ON ann.group_id = gr.group_id AND ann.task_id = gr.task_id AND ann.speaker = gr.speaker AND type = 'SPK' GROUP BY 1, 2, 3),
gi AS (SELECT group_id, task_id, CASE WHEN sum(x) = 0 THEN 0.0 ELSE sum((2 * i - 5) * x) / (4 * sum(x)) END AS g FROM (SELECT *, row_number() OVER (PARTITION BY group_id, task_id ORDER BY x) AS i FROM sp) GROUP BY 1, 2)
SELECT group_id, task_id, n_active_speakers, total_turns, round(st, 5) AS sil_time_s, sil_event_count, laughter_count, round(lt, 5) AS laughter_time_s, overlap_event_count, cc AS competitive_overlap_count, co AS cooperative_overlap_count,
  cl AS collaborative_overlap_count, nr AS needs_review_overlap_count, si AS simultaneous_overlap_count, bo AS backchannel_ovl_count, round(d, 3) AS task_duration_s, round(coalesce(h, 0), 5) AS transition_entropy_bits, round(g, 5) AS gini_speaking_time,
  CASE WHEN d <> 0 THEN round(st / d, 5) END AS sil_fraction, CASE WHEN cc + co > 0 THEN round(cc * 1.0::DOUBLE / (cc + co), 5) END AS conflict_overlap_ratio, round(act / CASE WHEN d > 0 THEN d / 60 ELSE 1.0 END, 5) AS engagement_density_per_min
FROM f JOIN td USING (group_id, task_id) LEFT JOIN te USING (group_id, task_id) JOIN gi USING (group_id, task_id)""")
def _(spark, sf):
    f = interaction.group_features(annotations(spark, sf), GT, P4)
    return rounded(f.withColumn("task_duration_s", F.round("task_duration_s", 3)), 5)


@query("transition_entropy", "WITH " + SAMPLES + """, tr AS (SELECT user_id, event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY t) AS x FROM s),
tc AS (SELECT user_id, x, y, count(*) AS n FROM tr WHERE x <> y GROUP BY ALL)
SELECT user_id, round(-sum(n / t * log2(n / t)), 6) AS transition_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) * 1.0::DOUBLE AS t FROM tc) GROUP BY 1""")
def _(spark, sf):
    return rounded(interaction.transition_entropy(samples(spark, sf), ["user_id"], "event_type", ["t"]))


@query("handovers", "WITH " + SAMPLES + """, g AS (SELECT task_id, event_type AS a, lead(event_type) OVER w AS b, lead(t) OVER w - (t + value * 60) AS gap FROM s WINDOW w AS (PARTITION BY task_id, user_id ORDER BY t))
SELECT task_id, a AS from_speaker, b AS to_speaker, count(*) AS n, round(avg(gap), 4) AS mean_gap, round(avg((gap < 0)::INT), 6) AS overlap_rate, round(avg((gap BETWEEN 0 AND 3600)::INT), 6) AS fast_rate,
  round(quantile_cont(gap, 0.5), 4) AS median_gap FROM g WHERE a <> b GROUP BY 1, 2, 3""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("z", F.col("t") + F.col("value") * 60)
    h = interaction.handovers(s, ["task_id", "user_id"], "event_type", "t", "z", 3600.0, table_keys=["task_id"])
    return rounded(h.withColumns({c: F.round(c, 4) for c in ("mean_gap", "median_gap")}))


@query("conversation_handovers", "WITH " + TURNS + """, g AS (SELECT conv_id, speaker AS a, lead(speaker) OVER w AS b, lead(onset) OVER w - "end" AS gap FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY onset, "end"))
SELECT conv_id, a AS from_speaker, b AS to_speaker, count(*) AS n, round(avg(gap), 5) AS mean_gap, round(avg((gap < 0)::INT), 6) AS overlap_rate, round(avg((gap BETWEEN 0 AND 0.2)::INT), 6) AS fast_rate, round(quantile_cont(gap, 0.5), 5) AS median_gap
FROM g WHERE a <> b GROUP BY 1, 2, 3""")
def _(spark, sf):
    h = interaction.handovers(turns(spark, sf), ["conv_id"], "speaker", "onset", "end")
    return rounded(h.withColumns({c: F.round(c, 5) for c in ("mean_gap", "median_gap")}))


@query("pause_features", "WITH " + TURNS + """, g AS (SELECT conv_id, lead(onset) OVER (PARTITION BY conv_id ORDER BY onset, "end") - "end" + (turn % 3) AS p FROM u)
SELECT conv_id, count(CASE WHEN p >= 0.5 THEN 1 END) AS n_pauses, round(avg(CASE WHEN p >= 0.5 THEN p END), 6) AS mean_pause, round(max(CASE WHEN p >= 0.5 THEN p END), 6) AS max_pause FROM g GROUP BY 1""")
def _(spark, sf):
    u = turns(spark, sf).withColumn("short_end", F.col("end") - F.col("turn") % 3)
    return rounded(interaction.pause_features(u, ["conv_id"], "onset", "short_end", 0.5))


@query("distinct_joined", "SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(spark, sf):
    return interaction.distinct_joined(table(spark, sf, "events"), ["user_id"], "event_type", "types")


@query("window_mode", "WITH " + SAMPLES + """, c AS (SELECT user_id, day(ts) AS d, event_type, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT user_id, d, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, event_type) = 1)
SELECT user_id, d, event_type AS mode, n AS n_mode FROM m""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("d", F.dayofmonth("ts").cast("long"))
    return interaction.most_frequent(s, ["user_id", "d"], "event_type")


@query("group_decision", "SELECT o_custkey, o_orderstatus AS decision, n AS n_mode FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) = 1")
def _(spark, sf):
    return interaction.most_frequent(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "decision")


@query("two_level_mean", """
WITH p AS (SELECT c_nationkey, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT n_regionkey, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM p JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice").join(c, "o_custkey").join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    m = stats.two_level_mean(o, ["o_custkey"], ["n_regionkey"], ["o_totalprice"])
    return rounded(m.select("n_regionkey", "n", F.col("o_totalprice_mean").alias("mean"), F.col("o_totalprice_sd").alias("sd")))


@query("group_pooling", """
SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_members, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_sd, count(l_quantity) AS l_quantity_n,
  round(avg(l_extendedprice), 6) AS l_extendedprice_mean, round(stddev_pop(l_extendedprice), 6) AS l_extendedprice_sd, count(l_extendedprice) AS l_extendedprice_n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    from gatherline.operators.signals import pool_members

    return pool_members(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"], "l_orderkey", 6, True)


@query("task_means", "SELECT l_orderkey, count(*) AS n_windows, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1")
def _(spark, sf):
    from gatherline.operators.stats import task_means

    return rounded(task_means(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_discount"]))


@query("dominance", "WITH " + SAMPLES + """, m AS (SELECT group_id, task_id, participant, sum(value) AS w FROM s GROUP BY ALL), h AS (SELECT *, w / sum(w) OVER (PARTITION BY group_id, task_id) AS s FROM m)
SELECT group_id, task_id, round(max(s), 6) AS share_max, round(avg(s), 6) AS share_mean, round(stddev_samp(s), 6) AS share_sd, round(min(s), 6) AS share_min, count(*) AS n_members FROM h GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(interaction.dominance(samples(spark, sf), GT, "participant", "value"))


@query("timing_class", "SELECT event_id, CASE WHEN event_id % 400 < 200 THEN 'simultaneous' WHEN value * 8 < 250 THEN 'backchannel_ovl' WHEN value * 8 < 500 THEN 'smooth' WHEN value * 8 < 1000 THEN 'competitive' ELSE 'floor_fight' END AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", interaction.timing_class(F.col("value") * 8, F.col("event_id") % 400).alias("label"))


@query("top_per_family", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    return top_row(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.struct("o_totalprice", -F.col("o_orderkey")))


@query("stratified_sample", """
WITH h AS (SELECT event_id, event_type, (event_id * 7919 + 104729) % 1000003 AS h FROM events)
SELECT event_type AS label, event_id FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) <= 40""")
def _(spark, sf):
    from gatherline.operators.sampling import stratified_sample

    e = table(spark, sf, "events").withColumn("h", (F.col("event_id") * 7919 + 104729) % 1000003)
    s = stratified_sample(e, "event_type", {k: 40 for k in ("click", "view", "error", "signup", "purchase")}, ["h", "event_id"])
    return s.select(F.col("event_type").alias("label"), "event_id")


@query("first_rows", "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS t FROM events ORDER BY ts LIMIT 100")
def _(spark, sf):
    return samples(spark, sf).orderBy("t").limit(100).select("event_id", F.round("t", 3).alias("t"))


@query("sorted_output", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy(F.desc("s_name"))


@query("tagged_union", "SELECT o_orderkey AS k, o_totalprice AS v, 'orders' AS source FROM orders UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer")
def _(spark, sf):
    from gatherline.operators.sets import tagged_union

    o = table(spark, sf, "orders")
    return tagged_union({"orders": (o, {"o_orderkey": "k", "o_totalprice": "v"}), "customer": (table(spark, sf, "customer"), {"c_custkey": "k", "c_acctbal": "v"})})


@query("distinct_cells", "SELECT DISTINCT user_id, day(ts) AS d FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("d")).distinct()


@query("missing_cells", "WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT day(ts) AS d FROM events) SELECT user_id, d FROM u, d EXCEPT SELECT user_id, day(ts) FROM events")
def _(spark, sf):
    from gatherline.operators.sets import missing_from

    cells = table(spark, sf, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("d"))
    days = F.explode(cells.agg(F.array_sort(F.collect_set("d"))).scalar())  # days of a month: 31 at most
    grid = cells.select("user_id").distinct().withColumn("d", days)
    return missing_from(grid, cells, ["user_id", "d"])


@query("present_in_both", "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def _(spark, sf):
    from gatherline.operators.sets import present_in_both

    e = table(spark, sf, "events")
    return present_in_both(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ["user_id"])
