"""The test tables seen as recordings: samples, annotations, transcript turns, vectors.

Each binding has a DataFrame form and the same thing as a SQL common table
expression, so a query and its reference SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.functions.exprs import epoch_seconds
from gatherline.operators.ordered import cum_sum, ordered_scan
from gatherline.plans.registry import table

DAY = 86400.0
BLOCK = 6 * DAY
ORIGIN = 1704067200.0  # 2024-01-01T00:00:00Z


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as a sensor stream: t in seconds, four people per group, five six-day tasks."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", F.expr("user_id div 4").alias("group_id"),
        F.concat(F.lit("P"), (F.col("user_id") % 4 + 1).cast("string")).alias("participant"),
        F.concat(F.lit("T"), F.expr("(dayofmonth(ts) - 1) div 6").cast("string")).alias("task_id"),
        "ts", epoch_seconds("ts").alias("t"), "event_type", "value", "props",
    )


SAMPLES = """s AS (
  SELECT event_id, user_id, user_id // 4 AS group_id, 'P' || CAST(user_id % 4 + 1 AS VARCHAR) AS participant,
         'T' || CAST((day(ts) - 1) // 6 AS VARCHAR) AS task_id, ts, epoch_us(ts) / 1e6 AS t,
         event_type, value, props
  FROM events)"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """events as coded annotations of a group-task recording (onset from the task's start)."""
    s = samples(spark, sf)
    onset = F.col("t") - F.lit(ORIGIN) - F.lit(BLOCK) * F.substring("task_id", 2, 1).cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "SPK").when(F.col("event_type") == "view", "BCK")
        .when(F.col("event_type") == "error", "OVL").when(F.col("event_type") == "signup", "LAU")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), "FP").otherwise("SIL")
    )
    sub = F.when(kind == "OVL", F.element_at(
        F.array(*[F.lit(x) for x in ("simultaneous", "backchannel_ovl", "smooth", "competitive", "floor_fight", "needs_review")]),
        (F.col("event_id") % 6 + 1).cast("int"))).otherwise("")
    ctx = F.when(kind == "OVL", F.element_at(
        F.array(*[F.lit(x) for x in ("", "collaborative", "completion", "competitive")]),
        (F.col("event_id") % 4 + 1).cast("int"))).otherwise("")
    return s.select(
        "event_id", "group_id", "task_id", F.col("participant").alias("speaker"), onset.alias("onset"),
        (F.col("value") * 10.0).alias("duration"), kind.alias("type"), sub.alias("subtype"),
        ctx.alias("context_label"), (F.col("value") * 100.0).alias("overlap_ms"),
    )


ANNOTATIONS = SAMPLES + """, ann0 AS (
  SELECT event_id, group_id, task_id, participant AS speaker,
         t - 1704067200.0::DOUBLE - 518400.0::DOUBLE * CAST(substr(task_id, 2, 1) AS INTEGER) AS onset,
         value * 10.0::DOUBLE AS duration,
         CASE WHEN event_type = 'click' THEN 'SPK' WHEN event_type = 'view' THEN 'BCK'
              WHEN event_type = 'error' THEN 'OVL' WHEN event_type = 'signup' THEN 'LAU'
              WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'FP' ELSE 'SIL' END AS type,
         value * 100.0::DOUBLE AS overlap_ms
  FROM s),
ann AS (
  SELECT *, CASE WHEN type = 'OVL' THEN ['simultaneous','backchannel_ovl','smooth','competitive','floor_fight','needs_review'][event_id % 6 + 1] ELSE '' END AS subtype,
         CASE WHEN type = 'OVL' THEN ['','collaborative','completion','competitive'][event_id % 4 + 1] ELSE '' END AS context_label
  FROM ann0)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as timed turns; a quarter second of overlap between neighbours."""
    c = table(spark, sf, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    c = ordered_scan(c, ["conv_id"], ["turn"], {"_upto": cum_sum("n_chars")})
    dur = F.col("n_chars") / F.lit(15.0)
    onset = (F.col("_upto") - F.col("n_chars")) / F.lit(15.0) - F.lit(0.25) * F.col("turn")
    return c.select(
        "conv_id", "turn", F.col("role").alias("speaker"), "text",
        onset.alias("onset"), dur.alias("duration"), (onset + dur).alias("end"),
    )


TURNS = """u0 AS (
  SELECT conv_id, turn, role AS speaker, text, length(text) AS n_chars,
         CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto
  FROM conversations),
u AS (
  SELECT conv_id, turn, speaker, text,
         (upto - n_chars) / 15.0::DOUBLE - 0.25::DOUBLE * turn AS onset, n_chars / 15.0::DOUBLE AS duration,
         ((upto - n_chars) / 15.0::DOUBLE - 0.25::DOUBLE * turn) + n_chars / 15.0::DOUBLE AS "end"
  FROM u0)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")
