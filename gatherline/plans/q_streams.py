"""Streaming queries, each run to the end of the events files."""

from pyspark.sql import functions as F

from gatherline.plans.bindings import SAMPLES
from gatherline.plans.registry import query, rounded, table
from gatherline.streaming import streams

# windows that end at or before the last event minus the allowed lateness are closed
_WM = "mx AS (SELECT floor(max(t) * 1000) / 1000 AS m FROM s)"


def _events(spark, sf):
    s = streams.read_events(spark, f"{sf}/event[s].parquet")
    return s.withColumn("group_id", F.expr("user_id div 4")).withColumn("t", F.unix_micros("event_time") / F.lit(1e6))


@query("stream_tumbling", "WITH " + SAMPLES + ", " + _WM + """, w AS (SELECT group_id, floor(t / 86400) * 86400.0::DOUBLE AS window_start, floor(t / 86400) * 86400.0::DOUBLE + 86400 AS window_end, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY ALL)
SELECT w.* FROM w, mx WHERE window_end <= m - 600""")
def _(spark, sf):
    s = streams.tumbling(_events(spark, sf), ["group_id"], "1 day", "10 minutes", [F.count("*").alias("n"), F.avg("value").alias("mean")])
    return rounded(streams.run_available(s))


@query("stream_sliding", "WITH " + SAMPLES + ", " + _WM + """, x AS (SELECT group_id, value, unnest([floor(t / 43200) * 43200.0::DOUBLE, floor(t / 43200) * 43200.0::DOUBLE - 43200]) AS window_start FROM s)
SELECT group_id, window_start, window_start + 86400 AS window_end, count(*) AS n, round(avg(value), 6) AS mean FROM x, mx WHERE window_start + 86400 <= m - 600 GROUP BY ALL""")
def _(spark, sf):
    s = streams.sliding(_events(spark, sf), ["group_id"], "1 day", "12 hours", "10 minutes", [F.count("*").alias("n"), F.avg("value").alias("mean")])
    return rounded(streams.run_available(s))


@query("stream_sessions", "WITH " + SAMPLES + ", " + _WM + """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 14400 THEN 0 ELSE 1 END AS b FROM s), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id, round(min(t), 3) AS window_start, round(max(t) + 14400, 3) AS window_end, count(*) AS n FROM i, mx GROUP BY user_id, k HAVING max(t) + 14400 <= max(m) - 600""")
def _(spark, sf):
    s = streams.sessions(_events(spark, sf), ["user_id"], "4 hours", "10 minutes", [F.count("*").alias("n")])
    return rounded(streams.run_available(s), 3)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    d = streams.deduplicate(_events(spark, sf), ["user_id", "event_type"], "60 days")
    return streams.run_available(d.select("user_id", "event_type"))


@query("stream_responses", "WITH " + SAMPLES + """SELECT a.event_id AS first_id, b.event_id AS second_id FROM s a JOIN s b ON a.group_id = b.group_id AND a.user_id <> b.user_id AND b.t >= a.t AND b.t <= a.t + 3600 WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def _(spark, sf):
    e = _events(spark, sf).select("event_id", "group_id", "user_id", "event_type", "event_time")
    r = streams.responses(e.filter("event_type = 'error'"), e.filter("event_type = 'click'"), ["group_id"], "1 HOUR", "10 minutes", F.col("user_id") != F.col("b_user_id"))
    return streams.run_available(r.select(F.col("event_id").alias("first_id"), F.col("b_event_id").alias("second_id")))


@query("stream_task_windows", "WITH " + SAMPLES + """, w AS (SELECT group_id, task_id AS task, min(t) + 3600 AS a, max(t) - 3600 AS z FROM s WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, task FROM s JOIN w ON s.group_id = w.group_id AND t >= a AND t < z""")
def _(spark, sf):
    from gatherline.plans.bindings import samples

    v = samples(spark, sf).filter("event_type = 'view'")
    w = v.groupBy("group_id", F.col("task_id").alias("task")).agg((F.min("t") + 3600).alias("a"), (F.max("t") - 3600).alias("z"))
    j = streams.enrich_from_windows(_events(spark, sf).select("event_id", "group_id", "t"), w, ["group_id"], "t", ("a", "z"), 86400.0)
    return streams.run_available(j.select("event_id", "task"))


def _events_in_files(spark, sf, files=4):
    """The events as a stream of several files, one micro-batch each, written one after the other in time."""
    e, folder = table(spark, sf, "events"), streams.work_folder(spark)
    day = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6)
    lo, hi = e.agg(F.min(day), F.max(day)).first()
    part = F.least(F.floor((day - F.lit(lo)) / F.lit((hi - lo) or 1.0) * files), F.lit(files - 1))
    for i in range(files):
        e.filter(part == i).coalesce(1).write.parquet(f"{folder}/part{i}")
    s = streams.read_events(spark, f"{folder}/part*", files_per_trigger=1)
    return s.withColumn("t", F.unix_micros("event_time") / F.lit(1e6))


# a run ends at a row without the flag, or when no row follows within the day; the end is seen once the watermark is past it
@query("stream_flag_runs", "WITH " + SAMPLES + ", " + _WM + """, f AS (SELECT user_id, t, value < 60 AS f, lag(value < 60) OVER w AS pf, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lead(value < 60) OVER w AS nf FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(CASE WHEN f AND pf AND t - pt <= 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM f)
SELECT user_id, round(min(t), 3) AS run_start, round(max(t), 3) AS run_end, count(*) AS n_rows FROM r, mx WHERE f GROUP BY user_id, g
HAVING least(floor((max(t) + 86400) * 1000), coalesce(floor(arg_max(CASE WHEN NOT nf THEN nt ELSE 1e12 END, t) * 1000), 1e15)) < (max(m) - 600) * 1000""")
def _(spark, sf):
    r = streams.flag_runs(_events_in_files(spark, sf), ["user_id"], "t", F.col("value") < 60, "10 minutes", 86400.0)
    return rounded(streams.run_available(r, rocks=True), 3)
