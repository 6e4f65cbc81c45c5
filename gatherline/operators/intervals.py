"""Joins on time: overlap, point in range, nearest, bounded gap.

Spark has no native range join, so a theta condition alone would become a nested
loop. Every join here is an equi join on (keys, time bucket) with the exact
condition checked afterwards; nothing is capped and no pair is lost.
Intervals are half open: [start, end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.operators.ordered import cum_max_before, cum_sum, last_valid, next_valid, ordered_scan, prev, settle


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width)))


def _buckets(start: Column, end: Column, width: float) -> Column:
    lo = _bucket(start, width)
    return F.explode(F.sequence(lo, F.greatest(lo, _bucket(end, width))))


def _key_cond(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return cond


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in df.columns])


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    how: str = "inner",
    right_prefix: str = "r_",
    extra: Column | None = None,
) -> DataFrame:
    """Pairs whose spans intersect: l.start < r.end and r.start < l.end, each pair once.

    ``width`` is the bucket length in the unit of the spans; near the usual span
    length is a good choice. ``extra`` may name left columns and prefixed right ones.
    ``how`` is inner, left_semi or left_anti.
    """
    ls, le = left_span
    rs, re = right_prefix + right_span[0], right_prefix + right_span[1]
    r = _prefixed(right, keys, right_prefix)
    lb = left.withColumn("_b", _buckets(F.col(ls), F.col(le), width))
    rb = r.withColumn("_b", _buckets(F.col(rs), F.col(re), width))
    hit = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    if extra is not None:
        hit = hit & extra
    if how == "inner":
        # a pair meets in several buckets; it counts in the one holding the start of the overlap
        once = F.col("_b") == _bucket(F.greatest(F.col(ls), F.col(rs)), width)
        return lb.join(rb, [*keys, "_b"], "inner").filter(hit & once).drop("_b")
    lid = lb.withColumn("_id", F.struct(*left.columns))
    matched = (
        lid.join(rb, [*keys, "_b"], "inner").filter(hit).select("_id").distinct()
        .withColumn("_h", F.xxhash64("_id"))
    )
    l2 = left.withColumn("_id", F.struct(*left.columns)).withColumn("_h", F.xxhash64("_id"))
    return l2.join(matched, ["_h", "_id"], how).select(*left.columns)


def within_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    t: str,
    span: tuple[str, str],
    width: float,
    closed: bool = False,
    how: str = "inner",
    prefix: str = "",
    extra: Column | None = None,
) -> DataFrame:
    """Points joined to the ranges that hold them; only the ranges are exploded to buckets."""
    r = _prefixed(ranges, keys, prefix)
    s, e = prefix + span[0], prefix + span[1]
    rb = r.withColumn("_b", _buckets(F.col(s), F.col(e), width))
    pb = points.withColumn("_b", _bucket(F.col(t), width))
    upper = F.col(t) <= F.col(e) if closed else F.col(t) < F.col(e)
    hit = (F.col(t) >= F.col(s)) & upper
    if extra is not None:
        hit = hit & extra
    cond = hit & (F.col("p._b") == F.col("w._b")) & _key_cond(keys, "p", "w")
    j = pb.alias("p").join(rb.alias("w"), cond, how)
    if how in ("left_semi", "left_anti"):
        return j.select(*points.columns)
    return j.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"w.{c}") for c in r.columns if c not in keys])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    direction: str = "backward",
    tolerance: float | None = None,
    prefix: str = "m_",
    rows_per_block: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Nearest earlier, later or closest right row for each left row.

    One union and one ordered scan: a long key is cut into blocks, not held in a
    task. 'nearest' prefers the earlier row on ties. Beyond ``tolerance`` the match is null.
    ``strict`` leaves out right rows at exactly the left time (backward or forward).
    """
    pay = F.struct(F.col(right_t).cast("double").alias("_t"), *[F.col(p).alias(p) for p in payload])
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(
        *keys, F.col(left_t).cast("double").alias("_at"), F.lit(1).alias("_side"),
        F.struct(*lcols).alias("_row"),
    )
    r = right.select(*keys, F.col(right_t).cast("double").alias("_at"), F.lit(0).alias("_side"), pay.alias("_pay"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_tie", F.xxhash64(F.col("_row"), F.col("_pay")))
    # at equal times the right row goes first, so it counts as earlier; forward needs it after
    side = -F.col("_side") if (direction == "forward") != strict else F.col("_side")
    steps = {}
    if direction != "forward":
        steps["_back"] = last_valid("_pay")
    if direction != "backward":
        steps["_fwd"] = next_valid("_pay")
    out = ordered_scan(both, keys, ["_at", side, "_tie"], steps, rows_per_block)
    out = out.filter(F.col("_side") == 1)
    if direction == "backward":
        best = F.col("_back")
    elif direction == "forward":
        best = F.col("_fwd")
    else:
        nearer = (F.col("_at") - F.col("_back._t")) <= (F.col("_fwd._t") - F.col("_at"))
        best = F.when(F.col("_fwd").isNull() | nearer, F.col("_back")).otherwise(F.col("_fwd"))
    if tolerance is not None:
        best = F.when(F.abs(best["_t"] - F.col("_at")) <= tolerance, best)
    return out.withColumn("_m", best).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in lcols],
        F.col("_m._t").alias(f"{prefix}t"), *[F.col(f"_m.{p}").alias(prefix + p) for p in payload],
    )


def merge_islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, rows_per_block: int | None = None
) -> DataFrame:
    """Union of the intervals of each key: one row per maximal covered stretch."""
    d = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    new = F.when(F.col("_top").isNull() | (F.col("_s") > F.col("_top")), 1).otherwise(0)
    d = ordered_scan(d, keys, ["_s", "_e"], {"_top": cum_max_before("_e")}, rows_per_block,
                     then=[({"_new": new}, {"_island": cum_sum("_new")})])
    return d.groupBy(*keys, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_island")


def _swept(intervals: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sweep of the end points of ``intervals`` (keys, _s, _e, _c, _w, _m) and the moments of ``points`` (keys, _t, _id, _sign, _long).

    One row each, in time: ``_n`` intervals (of weight _w) are open just before it, ``_sum`` is the sum of their codes, ``_from`` the
    moment before, ``_any`` the time so far in which an interval was open. ``_met`` adds up over a segment's two points to the
    number of marked intervals (_m) that share a moment with it: those that begin before its end less those that end by its start.
    For that an end (_sign 1) precedes the edges at its time and a start follows them. Intervals without length count for
    segments with length (_long) only.
    """
    edge = lambda t, d: intervals.select(
        *keys, F.col(t).alias("_t"), (F.lit(d) * F.col("_w")).alias("_d"), (F.col("_c") * d).alias("_c"), (F.lit(d) * F.col("_m")).alias("_b"), (F.col("_s") < F.col("_e")).alias("_wide"))
    rows = edge("_s", 1).unionByName(edge("_e", -1)).unionByName(points.withColumn("_d", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumns({"_tie": F.xxhash64("_d", "_c", "_id", "_b", "_wide"), "_place": -F.coalesce("_sign", F.lit(0))})
    before = {"_n": F.col("_cum") - F.col("_d"), "_sum": F.col("_codes") - F.coalesce("_c", F.lit(0)),
              "_open": F.when(F.col("_cum") - F.col("_d") >= 1, F.col("_t") - F.col("_from")).otherwise(0.0)}
    so_far = lambda d, wide: cum_sum(F.when((F.col("_b") == d) & (F.col("_wide") == F.lit(wide)), 1).otherwise(0))
    counts = {"_b1": so_far(1, True), "_f1": so_far(-1, True), "_b0": so_far(1, False), "_f0": so_far(-1, False)}
    out = ordered_scan(rows, keys, ["_t", "_place", "_tie"], {"_cum": cum_sum("_d"), "_codes": cum_sum(F.coalesce("_c", F.lit(0))), "_from": prev("_t"), **counts},
                       then=[(before, {"_any": cum_sum("_open")})])
    short = lambda c: F.when(F.col("_long"), F.col(c)).otherwise(0)
    return out.withColumn("_met", F.when(F.col("_sign") > 0, F.col("_b1") + short("_b0")).otherwise(-F.col("_f1") - short("_f0")))


def covered_seconds(
    segments: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    seg_id: str,
    span: tuple[str, str],
    not_same: str | None = None,
    points: bool = False,
) -> DataFrame:
    """Seconds of each segment covered by the UNION of the other rows' intervals; segments without any are left out.

    ``not_same`` names a column (speaker) that must differ; null speakers neither cover nor are covered.
    A sweep over the end points gives the time in which anybody was active up to each segment's start and end. Where a
    single speaker was, a second sweep per speaker takes the segment's own time off again. So the work is linear in
    the rows, however many overlap. Whether anybody else was active is counted, not read off the seconds, so the
    least overlap counts and rounding makes none. With ``points`` rows without length take part: inside another's interval
    they, and a segment that meets nothing else, have zero seconds.
    """
    s, e = span
    who = [not_same] if not_same else []
    whole = (F.col(s) <= F.col(e) if points else F.col(s) < F.col(e)) & (F.col(not_same).isNotNull() if who else F.lit(True))
    seg = segments.select(*keys, *who, seg_id, s, e).filter(whole).distinct()
    src = others.filter(whole)
    isl = merge_islands(src.filter(F.col(s) < F.col(e)), [*keys, *who], s, e)
    code = F.xxhash64(F.col(not_same)) if who else F.lit(0)
    wide = lambda c: c.cast("decimal(38,0)")
    spans = lambda d, c, w, m: d.select(*keys, F.col(s).cast("double").alias("_s"), F.col(e).cast("double").alias("_e"), wide(c).alias("_c"), F.lit(w).alias("_w"), F.lit(m).alias("_m"))
    one, each = spans(isl, code, 1, 0), spans(src, code, 0, 1)
    ends = F.inline(F.array(*[F.struct(F.col(c).cast("double").alias("_t"), F.lit(k).alias("_sign")) for c, k in ((s, -1), (e, 1))]))
    pts = seg.select(*keys, F.struct(seg_id, s, e, *who).alias("_id"), wide(code).alias("_own"), (F.col(s) < F.col(e)).alias("_long"), ends)
    swept = settle(_swept(one.unionByName(each.withColumn("_c", wide(F.lit(0)))), pts, keys))
    at = lambda d: d.filter(F.col("_sign").isNotNull()).groupBy(*keys, "_id").agg(F.sum(F.col("_sign") * F.col("_any")).alias("_v"), F.sum("_met").alias("_hits"))
    got = at(swept)
    if who:
        sole = swept.filter((F.col("_n") == 1) & (F.col("_t") > F.col("_from")))
        sole = sole.select(*keys, F.col("_sum").alias("_own"), F.col("_from").alias("_s"), F.col("_t").alias("_e"), wide(F.lit(0)).alias("_c"), F.lit(1).alias("_w"), F.lit(0).alias("_m"))
        mine = each.withColumns({"_own": F.col("_c"), "_c": wide(F.lit(0))})
        own = _swept(sole.unionByName(mine), pts, [*keys, "_own"]).filter(F.col("_sign").isNotNull()).select(*keys, "_id", (-F.col("_sign")).alias("_sign"), "_any", (-F.col("_met")).alias("_met"))
        got = at(swept.select(*keys, "_id", "_sign", "_any", "_met").unionByName(own))
    return got.filter("_hits > 0").select(*keys, F.col(f"_id.{seg_id}").alias(seg_id), F.greatest("_v", F.lit(0.0)).alias("covered_s"))
