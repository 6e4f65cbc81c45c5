"""Speech segments and vectors whose energies and embeddings are input columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherline.functions.exprs import cosine, row_mean
from gatherline.operators.groups import z_within
from gatherline.operators.ordered import join_on, settle


def energy_confidence(df: DataFrame, keys: Sequence[str], own: str, others_max: str | None = None, keep: float = 1.5, confident: float = 2.0) -> DataFrame:
    """Bleed rule: keep rows at least ``keep`` times louder than the loudest other row of the
    same key; at ``confident`` times they are confident, else uncertain.

    The loudest other is found from the two largest values of the key (partial aggregates).
    """
    if others_max is None:
        x = F.col(own)
        top = df.groupBy(*keys).agg(F.max(x).alias("_m1"))
        d = join_on(df, top, keys, "left")
        n_top = d.filter(x == F.col("_m1")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c1"))
        second = d.filter(x < F.col("_m1")).groupBy(*keys).agg(F.max(x).alias("_m2"))
        d = join_on(join_on(d, n_top, keys, "left"), second, keys, "left")
        d = d.withColumn("_other", F.when((x == F.col("_m1")) & (F.col("_c1") == 1), F.col("_m2")).otherwise(F.col("_m1"))).drop("_m1", "_m2", "_c1")
    else:
        d = df.withColumn("_other", F.col(others_max))
    r = F.when(F.col("_other") > 0, F.col(own) / F.col("_other"))
    loud = (F.col(own) > 0) & (r.isNull() | (r >= keep))
    return d.withColumn("energy_ratio", r).drop("_other").filter(loud).withColumn(
        "confidence", F.when(F.col("energy_ratio").isNull() | (F.col("energy_ratio") >= confident), "confident").otherwise("uncertain"))


def room_resolve(df: DataFrame, own: str, room: str, speaker: str, high: float = 0.3, low: float = 0.15, moderator: str = "MODERATOR") -> DataFrame:
    """Uncertain rows: confirmed above ``high`` of the room energy, moderator below ``low``."""
    r = F.when(F.col(room) > 0, F.col(own) / F.col(room))
    open_ = F.col("confidence") == "uncertain"
    return df.withColumns({
        speaker: F.when(open_ & (r < low), moderator).otherwise(F.col(speaker)),
        "confidence": F.when(open_ & ((r > high) | (r < low)), "confident").otherwise(F.col("confidence")),
    })


def frame_dominance(df: DataFrame, keys: Sequence[str], frame: str, member: str, rms: str, floor: float, energy_ratio: float) -> DataFrame:
    """Per key: share of frames each member dominates, and the cross-talk share.

    Frames hold one row per microphone; the two loudest come from ordered partial maxima.
    """
    x = F.col(rms)
    f = df.groupBy(*keys, frame).agg(
        F.max(F.struct(x.alias("v"), F.col(member).alias("m"))).alias("_a"), F.count_if(x > floor).alias("_loud"))
    second = df.join(f.select(*keys, frame, F.col("_a.m").alias(member)), [*keys, frame, member], "left_anti").groupBy(*keys, frame).agg(F.max(x).alias("_b"))
    f = join_on(f, second, [*keys, frame], "left")
    ratio = F.col("_a.v") / F.greatest(F.coalesce("_b", F.lit(floor)), F.lit(floor))
    wins = (F.col("_a.v") > floor) & (ratio >= energy_ratio)
    f = f.select(*keys, F.col("_a.m").alias("_m"), wins.alias("_w"), (F.col("_loud") >= 2).alias("_multi"), (ratio >= energy_ratio).alias("_dom"))
    return f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg(F.col("_w").cast("double")).alias("dominated_share"),
        F.coalesce(1.0 - F.avg(F.when(F.col("_multi"), F.col("_dom").cast("double"))), F.lit(0.0)).alias("crosstalk_share"))


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, out: str = "vector") -> DataFrame:
    """Element-wise mean per key; sums combine per (key, element), then a vector of fixed length is rebuilt."""
    d = df.select(*keys, F.posexplode(vec).alias("_d", "_x")).groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("_x").alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct("_d", "_m")))
    return d.groupBy(*keys).agg(F.transform(parts, lambda p: p["_m"]).alias(out), F.max("_n").alias("n_vectors"))


def profiles(df: DataFrame, member: str, quality: str, vec: str, top_n: int, tie: str) -> DataFrame:
    """Profile per member: mean vector of its ``top_n`` best rows (rank cut before the shuffle)."""
    w = Window.partitionBy(member).orderBy(F.desc(quality), tie)
    best = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n)
    return mean_vector(best, [member], vec, "profile")


def assign_profiles(df: DataFrame, prof: DataFrame, member: str, vec: str, duration: str, threshold: float, min_duration: float,
                    default: str, block: int = 1000) -> DataFrame:
    """Most similar profile per row; the default under the threshold or the minimum length.

    Profiles are one row per speaker, dealt into blocks of about ``block``. A row meets one block after the
    other, each as one array, and keeps its best so far (the smaller name on ties); every eighth time the rows are written.
    """
    prof = settle(prof.select(F.col(member).cast("string").alias("m"), F.col("profile").alias("p")))
    blocks = max(1, -(-prof.count() // block))
    d = df.withColumn("_best", F.struct(F.lit(-2.0).alias("s"), F.lit("").alias("m")))
    for i in range(blocks):
        packed = prof.filter(F.pmod(F.xxhash64("m"), F.lit(blocks)) == i).agg(F.array_sort(F.collect_list(F.struct("m", "p"))).alias("a"))
        scored = F.transform("_ps", lambda p: F.struct(F.round(cosine(F.col(vec), p["p"]), 9).alias("s"), p["m"].alias("m")))
        ahead = lambda a, x: F.when((x["s"] > a["s"]) | ((x["s"] == a["s"]) & (x["m"] < a["m"])), x).otherwise(a)
        d = d.withColumn("_ps", packed.scalar()).withColumn("_best", F.aggregate(scored, F.col("_best"), ahead)).drop("_ps")
        if i % 8 == 7:
            d = settle(d)
    ok = (F.col(duration) >= min_duration) & (F.col("_best.s") >= threshold)
    return d.withColumns({"assigned": F.when(ok, F.col("_best.m")).otherwise(default), "score": F.col("_best.s")}).drop("_best")


def likert_scores(df: DataFrame, ids: Sequence[str], items: Sequence[tuple[str, str, bool]], scale: dict[str, int] | None = None, top: int = 6) -> DataFrame:
    """Domain means of questionnaire items (column, domain, reversed); reversed items score top - v."""
    def score(c, rev):
        v = F.col(c).cast("double")
        if scale is not None:
            text = F.lower(F.trim(F.col(c)))
            v = F.coalesce(*[F.when(text == k, F.lit(float(x))) for k, x in scale.items()])
        return F.lit(float(top)) - v if rev else v

    domains = list(dict.fromkeys(d for _, d, _ in items))
    return df.select(*ids, *[row_mean([score(c, r) for c, dd, r in items if dd == d]).alias(d) for d in domains])


def within_task_composite(df: DataFrame, task: str, items: dict[str, Sequence[str]], out: str) -> DataFrame:
    """Mean of the within-task z scores of each task's own item set, and their raw mean."""
    cols = list(dict.fromkeys(c for cs in items.values() for c in cs))
    d = z_within(df, [task], cols, "_wz", population=False, zero_neutral=False)
    z = raw = None
    for t, cs in items.items():
        hit, a, b = F.col(task) == t, row_mean([f"{c}_wz" for c in cs]), row_mean(list(cs))
        z, raw = (F.when(hit, a), F.when(hit, b)) if z is None else (z.when(hit, a), raw.when(hit, b))
    return d.withColumns({out: z, f"{out}_raw": raw}).drop(*[f"{c}_wz" for c in cols])
