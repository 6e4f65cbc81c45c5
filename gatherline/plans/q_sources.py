"""Queries over scans and payload parsing."""

from pyspark.sql import functions as F

from gatherline.functions.exprs import epoch_seconds, group_label
from gatherline.plans.registry import query, rounded, table
from gatherline.sources import scans


@query("path_entities", """
SELECT page_id, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host,
       nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang,
       CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS item
FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    part = lambda pat: F.nullif(F.regexp_extract("url", pat, 1), F.lit(""))
    return p.select("page_id", part(r"^https?://([^/?#]+)").alias("host"), part(r"/([a-z]{2})/").alias("lang"),
                    part(r"/(\d+)").cast("long").alias("item"))


@query("group_label", """
SELECT doc_id, 'grp-' || lpad(regexp_extract(source, '(\\d+)', 1), 2, '0') AS group_id FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", group_label("source").alias("group_id"))


@query("session_allow_list", """
SELECT source, count(*) AS n FROM documents WHERE source IN ('src0','src3','src7') GROUP BY source""")
def _(spark, sf):
    d = scans.only_sessions(table(spark, sf, "documents"), "source", ["src0", "src3", "src7"])
    return d.groupBy("source").agg(F.count("*").alias("n"))


@query("file_union_provenance", """
SELECT 'documents.parquet' AS file, source, count(*) AS n FROM documents GROUP BY source""")
def _(spark, sf):
    d = scans.with_provenance(spark.read.parquet(f"{sf}/documents.parquet"))
    return d.groupBy(scans.part_below("source_path", sf).alias("file"), "source").agg(F.count("*").alias("n"))


@query("numeric_coercion", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"))
    return scans.coerce_numeric(e, ["k", "bad"])


@query("json_phase", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), event_type) AS k,
       coalesce(json_extract_string(props, '$.phase'), event_type) AS phase FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", scans.json_field("props", "k", "event_type").alias("k"),
                    scans.json_field("props", "phase", "event_type").alias("phase"))


@query("payload_items", """
SELECT event_id, 'k' AS item_key, json_extract_string(props, '$.k') AS item_value FROM events
UNION ALL SELECT event_id, 'v', event_type FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    # a nested payload with a meta key, made from the columns
    payload = F.concat(F.lit('{"meta":"x","answers":{"v":"'), F.col("event_type"), F.lit('"},'), F.expr("substring(props, 2)"))
    return scans.payload_items(e.withColumn("payload", payload), "payload", ["event_id"], ["meta"])


@query("response_items", """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'valence' AS item_key, k AS item_value FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 'a', event_type FROM e WHERE event_type NOT IN ('click', 'error')
UNION ALL SELECT event_id, 'probe_name', 'p1' FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'responses', '{"a":"' || event_type || '"}' FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'valence', k FROM e WHERE event_type NOT IN ('click', 'view')
UNION ALL SELECT event_id, 'arousal', NULL FROM e WHERE event_type NOT IN ('click', 'view')""")
def _(spark, sf):
    # payloads of four types, made from the columns
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", " VAD").when(F.col("event_type") == "view", "postblock").when(F.col("event_type") == "error", "probe").otherwise("other")
    payload = F.concat(F.lit('{"type":"'), kind, F.lit('","participant":"P1","probe_name":"p1","responses":{"a":"'), F.col("event_type"), F.lit('"},"valence":'),
                       F.get_json_object("props", "$.k"), F.lit(',"arousal":null}'))
    return scans.response_items(e.withColumn("payload", payload), "payload", ["event_id"], ["type", "participant", "probe_name"])


@query("file_entities", """
SELECT event_id, 'ses-' || CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_id % 6 < 5 THEN 'T' || CAST(event_id % 6 AS VARCHAR) END AS task_id,
       CASE WHEN event_id % 5 > 0 THEN 'P' || CAST(event_id % 5 AS VARCHAR) END AS participant_id, 'grp-' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS group_id FROM events""")
def _(spark, sf):
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("/data/ses-"), text(F.col("user_id")), F.lit("/GRP_"), text(F.col("user_id") % 20), F.lit("_T"), text(F.col("event_id") % 6),
                    F.lit("_P"), text(F.col("event_id") % 5), F.lit(".tsv.gz"))
    e = table(spark, sf, "events").withColumn("path", path)
    return e.select("event_id", *[c.alias(k) for k, c in scans.path_entities("path").items()])


@query("ndjson_lines", """
SELECT to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS line FROM events""")
def _(spark, sf):
    return scans.to_ndjson(table(spark, sf, "events"), ["event_id", "user_id", "event_type"])


@query("ndjson_round_trip", "SELECT event_id, round(value, 6) AS value, event_type FROM events")
def _(spark, sf):
    lines = scans.to_ndjson(table(spark, sf, "events"), ["event_id", "value", "event_type"])
    return rounded(scans.from_ndjson(lines, "event_id long, value double, event_type string"))


@query("strip_padding", """
SELECT doc_id, md5(regexp_replace('  ' || text || ' ', '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias(" doc_id "), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text  "))
    return scans.strip_padding(d).select("doc_id", F.md5("text").alias("digest"))


@query("stream_demultiplex", """
SELECT CASE WHEN event_type LIKE '%click%' THEN 'motion' WHEN event_type LIKE '%view%' THEN 'gaze' ELSE 'other' END AS modality,
       'P' || CAST(user_id % 4 + 1 AS VARCHAR) AS participant_id, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "events")
    e = e.withColumn("stream", F.concat("event_type", F.lit("_P"), (F.col("user_id") % 4 + 1).cast("string")))
    d = scans.demultiplex(e, "stream", {"click": "motion", "view": "gaze"}, r"_(P[1-4])$")
    return rounded(d.groupBy("modality", "participant_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query("sample_channels", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
       CAST(embedding[1000] AS DOUBLE) AS absent FROM embeddings""")
def _(spark, sf):
    v = scans.channels(table(spark, sf, "embeddings"), "embedding", {"x": 0, "y": 1, "absent": 999})
    return rounded(v.select("vec_id", "x", "y", "absent"))


@query("marker_events", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS marker_k,
       CASE WHEN event_id % 3 = 0 THEN 'T' || CAST(user_id % 5 AS VARCHAR) END AS marker_task,
       round(epoch_us(ts) / 1e6, 6) AS marker_wall_clock FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("t", epoch_seconds("ts"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("start T"), (F.col("user_id") % 5).cast("string"), F.lit(" now"))).otherwise(F.col("props"))
    m = scans.marker_events(e.withColumn("text", text), "text", "t", "k long, task string, wall_clock double")
    return rounded(m.select("event_id", "marker_k", "marker_task", "marker_wall_clock"))
