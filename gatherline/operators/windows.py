"""Windows over recordings, and rules that walk along a stream.

Everything ordered goes through ``ordered_scan``, so one long stream is cut into
blocks instead of landing in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from gatherline.operators.groups import with_stats
from gatherline.operators.ordered import (
    cum_sum, exact_percentiles, join_on, last_valid, last_valid_before, next_, next_valid, ordered_scan, prev, row_no, settle, top_row,
)

FRAME_BLOCK = 200_000
#: Rows of a key whose peaks are found in one piece.
PEAK_BLOCK = 50_000


# ------------------------------------------------------------------ window tables


def anchored_windows(df: DataFrame, keys: Sequence[str], t: str, length: float, step: float) -> DataFrame:
    """Sliding windows anchored at each stream's first sample.

    Adds window_index, window_start, window_end; a sample repeats once per window
    holding it (at most ceil(length/step)). The last partial window is dropped.
    """
    d = with_stats(df.filter(F.col(t).isNotNull()), keys, {"_t0": F.min(t), "_t1": F.max(t)})
    rel = F.col(t) - F.col("_t0")
    lo = F.greatest(F.floor((rel - length) / step), F.lit(0))
    hi = F.floor(rel / step) + 1
    d = d.withColumn("window_index", F.explode(F.sequence(lo, hi)))
    start = F.col("_t0") + F.col("window_index") * F.lit(float(step))
    d = d.withColumns({"window_start": start, "window_end": start + F.lit(float(length))})
    ok = (F.col(t) >= F.col("window_start")) & (F.col(t) < F.col("window_end")) & (F.col("window_end") <= F.col("_t1") + 1e-6)
    return d.filter(ok).drop("_t0", "_t1")


def fixed_bins(df: DataFrame, onset: str, width: float, out: str = "window_index") -> DataFrame:
    """floor(onset / width); null and negative onsets are dropped."""
    return df.filter(F.col(onset) >= 0).withColumn(out, F.floor(F.col(onset) / F.lit(float(width))))


def covered_spine(df: DataFrame, keys: Sequence[str], onset: str, end: Column, width: float, jitter: float) -> DataFrame:
    """Every window between first onset - jitter and last end + jitter of each key."""
    span = df.groupBy(*keys).agg(F.min(onset).alias("span_onset"), F.max(end).alias("span_end"))
    lo = F.greatest(F.floor((F.col("span_onset") - jitter) / width), F.lit(0))
    hi = F.floor((F.col("span_end") + jitter) / width)
    return span.filter(hi >= lo).withColumn("window_index", F.explode(F.sequence(lo, hi)))


def zero_fill(spine: DataFrame, features: DataFrame, keys: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Covered windows without events get 0 in ``zero`` columns; other columns stay null."""
    j = join_on(spine, features, [*keys, "window_index"], "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(features.schema[c].dataType)) for c in zero})


def window_apply(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """User hook: a pandas function on the rows of one window, which returns a frame or, for a single row, a tuple.

    Windows are the unit of work, so a long stream never lands in one call; prefer aggregates where they exist.
    Rows are shuffled and sorted by window and read in batches of many windows, so a window costs little
    more than the call itself. Only a window that crosses batches is put together from them.
    """
    wk = [*keys, "window_index"]
    names = [c.split()[0] for c in schema.split(",")]

    def edges(rows: pd.DataFrame) -> np.ndarray:
        """Where another window begins, the first row aside."""
        new = np.zeros(max(len(rows) - 1, 0), bool)
        for k in wk:
            code = pd.factorize(rows[k], use_na_sentinel=False)[0]
            new |= code[1:] != code[:-1]
        return np.flatnonzero(new) + 1

    def run(batches):
        held: list[pd.DataFrame] = []  # the pieces of the window that may go on
        out: list = []

        def call(rows: pd.DataFrame):
            got = fn(rows.reset_index(drop=True))
            out.append(got if isinstance(got, pd.DataFrame) else tuple(got))

        def made():
            plain = [r for r in out if isinstance(r, tuple)]
            frames = [r for r in out if not isinstance(r, tuple)]
            out.clear()
            return pd.concat([*([pd.DataFrame(plain, columns=names)] if plain else []), *frames], ignore_index=True)

        for batch in batches:
            if not len(batch):
                continue
            if held and len(edges(pd.concat([held[-1][wk].tail(1), batch[wk].head(1)], ignore_index=True))):
                call(pd.concat(held, ignore_index=True))
                held.clear()
            at = [0, *edges(batch).tolist(), len(batch)]
            if len(at) > 2:
                call(pd.concat([*held, batch.iloc[: at[1]]], ignore_index=True))
                held.clear()
                for a, b in zip(at[1:-2], at[2:-1]):
                    call(batch.iloc[a:b])
            held.append(batch.iloc[at[-2] :])
            if out:
                yield made()
        if held:
            call(pd.concat(held, ignore_index=True))
            yield made()

    return df.repartition(*wk).sortWithinPartitions(*wk).mapInPandas(run, schema)


# ------------------------------------------------------------------ frames around a row


def centred_frame(df: DataFrame, keys: Sequence[str], order: Sequence, half: int, outs: dict, block: int | None = None,
                  rows_per_block: int | None = None) -> DataFrame:
    """Aggregates over the rows from ``half`` before to ``half`` after, by position.

    Streams are cut into position blocks that overlap by ``half`` rows, so the frame
    is exact at block edges. ``outs`` maps a name to an aggregate Column.
    """
    block = block or FRAME_BLOCK
    d = ordered_scan(df, keys, order, {"_pos": row_no()}, rows_per_block)
    own = F.floor((F.col("_pos") - 1) / block)
    reach = F.sequence(F.floor(F.greatest(F.col("_pos") - 1 - half, F.lit(0)) / block), F.floor((F.col("_pos") - 1 + half) / block))
    d = d.withColumn("_own", own).withColumn("_fb", F.explode(reach))
    w = Window.partitionBy(*keys, "_fb").orderBy("_pos").rowsBetween(-half, half)
    d = d.withColumns({k: v.over(w) for k, v in outs.items()})
    return d.filter(F.col("_own") == F.col("_fb")).drop("_pos", "_own", "_fb")


def tonic_phasic(df: DataFrame, keys: Sequence[str], order: Sequence, x: str, half: int, block: int | None = None) -> DataFrame:
    """tonic = centred rolling median, phasic = the rest (the median form, not a filter)."""
    d = centred_frame(df, keys, order, half, {"tonic": F.percentile(F.col(x), 0.5)}, block)
    return d.withColumn("phasic", F.col(x) - F.col("tonic"))


# ------------------------------------------------------------------ runs and islands


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence, flag: Column, rows_per_block: int | None = None) -> DataFrame:
    """Add ``run_id``: a number that changes when ``flag`` changes along the stream."""
    d = df.withColumn("_flag", flag)
    changed = F.when(F.col("_no") == 1, 0).otherwise((~F.col("_flag").eqNullSafe(F.col("_was"))).cast("int"))
    d = ordered_scan(d, keys, order, {"_was": prev("_flag"), "_no": row_no()}, rows_per_block,
                     then=[({"_chg": changed}, {"run_id": cum_sum("_chg")})])
    return d.drop("_was", "_no", "_chg")


def flag_runs(df: DataFrame, keys: Sequence[str], order: Sequence, t: str, flag: Column, min_rows: int = 1,
              min_s: float | None = None, max_s: float | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Maximal runs where ``flag`` holds: start, end, n_rows, duration; filtered by length."""
    runs = label_runs(df, keys, order, flag, rows_per_block).filter(F.col("_flag"))
    out = runs.groupBy(*keys, "run_id").agg(
        F.min(t).alias("run_start"), F.max(t).alias("run_end"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("duration", F.col("run_end") - F.col("run_start")).filter(F.col("n_rows") >= min_rows)
    if min_s is not None:
        out = out.filter(F.col("duration") >= min_s)
    if max_s is not None:
        out = out.filter(F.col("duration") <= max_s)
    return out


def fixations(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, max_speed: float, max_gap: float, min_rows: int = 3,
              rows_per_block: int | None = None) -> DataFrame:
    """Runs of slow samples; a gap over ``max_gap`` breaks a run. Centroid, span and size per run.

    The first sample of a stream counts as still; a sample that arrives fast or late
    ends the run and belongs to none.
    """
    dt = F.col(t) - F.col("_pt")
    dist = F.sqrt((F.col(x) - F.col("_px")) ** 2 + (F.col(y) - F.col("_py")) ** 2)
    still = F.when(F.col("_pt").isNull(), True).when((dt <= 0) | (dt > max_gap), False).otherwise(dist / dt <= max_speed)
    d = ordered_scan(df, keys, [t], {"_pt": prev(t), "_px": prev(x), "_py": prev(y)}, rows_per_block,
                     then=[({"_still": F.coalesce(still, F.lit(False))}, {"_run": cum_sum((~F.col("_still")).cast("int"))})])
    return d.filter("_still").groupBy(*keys, "_run").agg(
        F.min(t).alias("start"), (F.max(t) - F.min(t)).alias("duration"), F.count(F.lit(1)).alias("n_samples"),
        F.avg(x).alias("cx"), F.avg(y).alias("cy"),
    ).filter(F.col("n_samples") >= min_rows).drop("_run")


def with_speed(df: DataFrame, keys: Sequence[str], t: str, coords: Sequence[str], valid: Column | None = None,
               rows_per_block: int | None = None) -> DataFrame:
    """Speed from the previous sample; null unless both neighbours are valid and time moves on."""
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    d = df
    for i, c in enumerate(coords):
        d = d.withColumn(f"_c{i}", F.when(ok, F.col(c)))
    steps = {f"_b{i}": prev(f"_c{i}") for i in range(len(coords))}
    d = ordered_scan(d, keys, [t], {**steps, "_pt": prev(t)}, rows_per_block)
    sq = sum(((F.col(f"_c{i}") - F.col(f"_b{i}")) ** 2 for i in range(len(coords))), F.lit(0.0))
    dt = F.col(t) - F.col("_pt")
    drop = [f"_c{i}" for i in range(len(coords))] + list(steps) + ["_pt"]
    return d.withColumn("speed", F.when(dt > 0, F.sqrt(sq) / dt)).drop(*drop)


def reject_jumps(df: DataFrame, keys: Sequence[str], order: str, x: str | Sequence[str], max_step: float, out: str | None = None,
                 rows_per_block: int | None = None) -> DataFrame:
    """Null a value that jumped more than ``max_step`` per unit of ``order`` from the valid one before.

    ``x`` may list the coordinates of a point: the jump is the distance, a point is valid where its first
    coordinate is, and all its coordinates go. With ``out``, a single value is kept and the result put there.
    A rejected value no longer counts as neighbour for the very next test, so of
    consecutive jump candidates the 1st, 3rd, 5th ... go.
    """
    at = [x] if isinstance(x, str) else list(x)
    if out and len(at) > 1:
        raise ValueError("out goes with a single value")
    before = [f"_px{i}" for i in range(len(at))]
    v = df.filter(F.col(at[0]).isNotNull())
    apart = [F.col(c) - F.col(b) for c, b in zip(at, before, strict=True)]
    jump = F.abs(apart[0]) if len(at) == 1 else F.sqrt(sum((a * a for a in apart), F.lit(0.0)))
    cand = F.coalesce(jump > max_step * (F.col(order) - F.col("_po")), F.lit(False))
    v = ordered_scan(v, keys, [order], {**{b: prev(c) for c, b in zip(at, before, strict=True)}, "_po": prev(order), "_no": row_no()}, rows_per_block,
                     then=[({"_cand": cand}, {"_calm": last_valid(F.when(~F.col("_cand"), F.col("_no")))})])
    nth = F.col("_no") - F.coalesce(F.col("_calm"), F.lit(0))
    bad = F.col("_cand") & (nth % 2 == 1)
    new = {out: F.when(~bad, F.col(at[0]))} if out else {c: F.when(~bad, F.col(c)) for c in at}
    kept = v.withColumns(new).drop(*before, "_po", "_no", "_cand", "_calm")
    rest = df.filter(F.col(at[0]).isNull())
    if out:
        rest = rest.withColumn(out, F.lit(None).cast("double"))
    return kept.unionByName(rest)


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence, x: str, out: str, max_gap: int | None = None,
              rows_per_block: int | None = None) -> DataFrame:
    """Linear fill by row position. Without ``max_gap`` the ends are held; with it only
    inner gaps of at most that many rows are filled."""
    at = F.when(F.col(x).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(x).alias("v")))
    d = ordered_scan(df, keys, order, {"_pos": row_no()}, rows_per_block,
                     then=[({"_at": at}, {"_l": last_valid("_at"), "_n": next_valid("_at")})])
    gap = F.col("_n.p") - F.col("_l.p")
    lin = F.col("_l.v") + (F.col("_n.v") - F.col("_l.v")) * (F.col("_pos") - F.col("_l.p")) / gap
    if max_gap is None:
        fill = F.coalesce(lin, F.col("_l.v"), F.col("_n.v"))
    else:
        fill = F.when(gap - 1 <= max_gap, lin)
    return d.withColumn(out, F.coalesce(F.col(x).cast("double"), fill)).drop("_pos", "_at", "_l", "_n")


# ------------------------------------------------------------------ peaks and beats


def local_maxima(df: DataFrame, keys: Sequence[str], order: str, x: str, min_distance: int, rule: str = "sd",
                 rows_per_block: int | None = None) -> DataFrame:
    """Peaks above a threshold and at least ``min_distance`` rows after the peak kept before.

    rule 'sd': mean + 0.5 population sd; rule 'mad': median + 0.8 MAD. Every candidate points at the next one
    far enough away. Inside blocks of PEAK_BLOCK rows the pointers are followed by doubling; a block passes on
    where each possible first peak of it leads, a few candidates, so no run of close candidates is held whole.
    """
    d = df.filter(F.col(x).isNotNull())
    if rule == "sd":
        d = with_stats(d, keys, {"_m": F.avg(x), "_s": F.stddev_pop(x)}).withColumn("_thr", F.col("_m") + 0.5 * F.col("_s")).drop("_m", "_s")
    else:
        med = exact_percentiles(d, keys, {"_m": (x, 0.5)})
        d = join_on(d, med, keys, "left")
        mad = exact_percentiles(d.withColumn("_dev", F.abs(F.col(x) - F.col("_m"))), keys, {"_s": ("_dev", 0.5)})
        d = join_on(d, mad, keys, "left").withColumn("_thr", F.when(F.col("_s") > 0, F.col("_m") + 0.8 * F.col("_s"))).drop("_m", "_s")
    d = ordered_scan(d, keys, [order], {"_p": prev(x), "_q": next_(x), "pos": row_no()}, rows_per_block)
    v = F.col(x)
    c = d.filter((v > F.col("_thr")) & (v >= F.col("_p")) & (v > F.col("_q")))
    found = F.array_sort(F.collect_list(F.struct("pos", F.col(order).alias("peak_at"), v.alias("peak_value"))))
    blocks = settle(c.withColumn("_blk", F.floor(F.col("pos") / PEAK_BLOCK)).groupBy(*keys, "_blk").agg(found.alias("_c")))
    leads, chosen, kept = _peak_steps(min_distance, PEAK_BLOCK)
    at = F.transform("_c", lambda p: p["pos"])
    ends = blocks.select(*keys, "_blk", leads(at, "_blk").alias("_e"))
    path = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_blk", "_e.entry", "_e.exit"))).alias("_b"))
    part = lambda name: F.transform("_b", lambda b: b[name])
    starts = path.select(*keys, F.explode(F.arrays_zip(part("_blk").alias("blk"), chosen(part("entry"), part("exit")).alias("at"))).alias("_s"))
    starts = starts.select(*keys, F.col("_s.blk").alias("_blk"), F.col("_s.at").alias("_first")).filter(F.col("_first") >= 0)
    rows = join_on(blocks, starts, [*keys, "_blk"], "inner").withColumn("_i", kept(at, "_first"))
    out = rows.select(*keys, F.explode(F.transform("_i", lambda i: F.get("_c", i))).alias("_k"))
    return out.select(*keys, F.col("_k.pos").alias("pos"), F.col("_k.peak_at").alias("peak_at"), F.col("_k.peak_value").alias("peak_value"))


def _peak_steps(distance: int, block: int):
    """Functions of a block's sorted candidates: where its possible first peaks lead, the first peak of each block
    of a key (-1 where none is far enough), and the places of the peaks kept after a first one."""

    def following(p: np.ndarray) -> np.ndarray:
        return np.searchsorted(p, p + distance)

    @F.pandas_udf("entry array<long>, exit array<long>")
    def leads(pos: pd.Series, blk: pd.Series) -> pd.DataFrame:
        entry, exit_ = [], []
        for p, b in zip(pos, blk, strict=True):
            at = following(p)
            end = np.where(at < len(p), at, np.arange(len(p)))
            while (end[end] != end).any():
                end = end[end]
            n = np.searchsorted(p, b * block + distance - 1) + 1
            entry.append(p[:n])
            exit_.append(p[end[:n]])
        return pd.DataFrame({"entry": entry, "exit": exit_})

    @F.pandas_udf("array<long>")
    def chosen(entry: pd.Series, exit_: pd.Series) -> pd.Series:
        out = []
        for es, xs in zip(entry, exit_, strict=True):
            firsts, last = [], -distance
            for e, x in zip(es, xs, strict=True):
                i = int(np.searchsorted(e, last + distance))
                firsts.append(int(e[i]) if i < len(e) else -1)
                last = int(x[i]) if i < len(e) else last
            out.append(firsts)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def kept(pos: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for p, f in zip(pos, first, strict=True):
            at, i, places = following(p), int(np.searchsorted(p, f)), []
            while i < len(p):
                places.append(i)
                i = int(at[i])
            out.append(places)
        return pd.Series(out)

    return leads, chosen, kept


def beat_features(beats: DataFrame, keys: Sequence[str], at: str, to_ms: float, expected: DataFrame | None = None,
                  low_ms: float = 300.0, high_ms: float = 2000.0, spread_ms: float = 250.0, tolerance_ms: float = 50.0) -> DataFrame:
    """Interval features of a beat series: clean intervals, rate, RMSSD, SDNN, pNN50, quality.

    ``expected`` may give ``expected_bpm`` per key; without it agreement scores 0.5. A series with fewer than
    two clean intervals stays, with none counted, quality 0 and nothing else.
    """
    d = ordered_scan(beats, keys, [at], {"_p": prev(at)})
    d = settle(d.withColumn("ibi", (F.col(at) - F.col("_p")) * to_ms).filter(F.col("ibi").isNotNull()).select(*keys, at, "ibi"))
    n_all = beats.groupBy(*keys).agg(F.greatest(F.count(at) - 1, F.lit(0)).alias("n_ibi"))
    ok = d.filter(F.col("ibi").between(low_ms, high_ms))
    med = exact_percentiles(ok, keys, {"_med": ("ibi", 0.5)})
    near = join_on(ok, med, keys, "inner").filter(F.abs(F.col("ibi") - F.col("_med")) <= F.greatest(F.lit(spread_ms), 0.25 * F.col("_med")))
    near = settle(ordered_scan(near, keys, [at], {"_pi": prev("ibi")}).withColumn("_d", F.col("ibi") - F.col("_pi")))
    f = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clean"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
        F.stddev_samp("ibi").alias("sdnn"), (F.avg((F.abs("_d") > tolerance_ms).cast("double")) * 100.0).alias("pnn50"),
    ).filter(F.col("n_clean") >= 2)
    f = join_on(f, exact_percentiles(near, keys, {"_cm": ("ibi", 0.5)}), keys, "left")
    f = join_on(n_all, f, keys, "left").withColumn("bpm", 60000.0 / F.col("_cm")).drop("_cm")
    if expected is not None:
        f = join_on(f, expected.select(*keys, "expected_bpm"), keys, "left")
        agree = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(F.col("bpm") - F.col("expected_bpm")) / 30.0)), F.lit(0.5))
    else:
        agree = F.lit(0.5)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    # fixed values: weights and limits of the quality score (0.4, 0.3, 0.2, 0.1; 30 beats a minute, 300 ms, 30 intervals)
    quality = (0.4 * F.col("n_clean") / F.greatest(F.col("n_ibi"), F.lit(1)) + 0.3 * agree
               + 0.2 * F.coalesce(clip(1.0 - F.col("rmssd") / 300.0), F.lit(0.0)) + 0.1 * clip(F.col("n_clean") / 30.0))
    return f.withColumns({"quality": F.coalesce(quality, F.lit(0.0)), "n_clean": F.coalesce("n_clean", F.lit(0))}).drop("expected_bpm")


def best_channel(df: DataFrame, keys: Sequence[str], channel: str) -> DataFrame:
    """The channel with the highest quality per key (lowest channel on ties)."""
    return top_row(df, keys, F.struct(F.col("quality"), -F.col(channel)))


# ------------------------------------------------------------------ progress, phases, dedup


def task_progress(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """``progress`` 0..1 inside each key and its third: early, middle or late (right closed)."""
    d = with_stats(df, keys, {"_a": F.min(start), "_z": F.max(end)})
    d = d.withColumn("progress", (F.col(start) - F.col("_a")) / F.greatest(F.col("_z") - F.col("_a"), F.lit(1e-9))).drop("_a", "_z")
    p = F.col("progress")
    third = F.when((p > -0.001) & (p <= 1 / 3), "early").when((p > 1 / 3) & (p <= 2 / 3), "middle").when((p > 2 / 3) & (p <= 1.001), "late")
    return d.withColumn("segment", third)


def phase_durations(df: DataFrame, keys: Sequence[str], onset: str, end: str, rows_per_block: int | None = None) -> DataFrame:
    """Time to the next phase; the last one runs to the task's end."""
    d = ordered_scan(df, keys, [onset], {"_n": next_(onset)}, rows_per_block)
    return d.withColumn("phase_s", F.coalesce(F.col("_n"), F.col(end)) - F.col(onset)).drop("_n")


def response_gaps(df: DataFrame, keys: Sequence[str], speaker: str, onset: str, end: str, rows_per_block: int | None = None) -> DataFrame:
    """For each turn: who spoke next, the gap to them, and whether that was an interruption.

    Gap and interruption are filled only when the next speaker differs.
    """
    d = ordered_scan(df, keys, [onset, end], {"next_speaker": next_(speaker), "_no": next_(onset)}, rows_per_block)
    other = F.col("next_speaker").isNotNull() & (F.col("next_speaker") != F.col(speaker))
    gap = F.when(other, F.col("_no") - F.col(end))
    return d.withColumns({"gap": gap, "interrupted": F.when(other, gap < 0)}).drop("_no")


def dedup_longest(df: DataFrame, keys: Sequence[str], onset: str, duration: str, tie: str, digits: int = 2) -> DataFrame:
    """Rows whose onset rounds to the same value collapse to the longest (lowest ``tie`` on equal)."""
    scale = F.lit(float(10 ** digits))
    d = df.withColumn("_at", F.rint(F.col(onset) * scale) / scale)
    return top_row(d, [*keys, "_at"], F.struct(F.col(duration), -F.col(tie))).drop("_at")


def latest(df: DataFrame, keys: Sequence[str], clock: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``clock`` (give a total order)."""
    return top_row(df, keys, F.struct(*clock))


def turn_cohesion(df: DataFrame, keys: Sequence[str], order: Sequence, words: str, rows_per_block: int | None = None) -> DataFrame:
    """Jaccard overlap of each turn's word set with the last non-empty turn before it."""
    ws = F.array_distinct(F.col(words))
    d = df.withColumn("_w", F.when(F.size(ws) > 0, ws))
    d = ordered_scan(d, keys, order, {"_b": last_valid_before("_w")}, rows_per_block)
    j = F.size(F.array_intersect("_w", "_b")) / F.size(F.array_union("_w", "_b"))
    return d.withColumn("cohesion", F.when(F.col("_w").isNotNull() & F.col("_b").isNotNull(), j)).drop("_w", "_b")


def vector_continuity(df: DataFrame, keys: Sequence[str], order: Sequence, vec: str, speaker: str, similarity, rows_per_block: int | None = None) -> DataFrame:
    """Similarity of each vector to the one before, where the speaker changed."""
    d = ordered_scan(df, keys, order, {"_pv": prev(vec), "_ps": prev(speaker)}, rows_per_block)
    return d.withColumn("continuity", F.when(F.col("_ps") != F.col(speaker), similarity(F.col(vec), F.col("_pv")))).drop("_pv", "_ps")


# ------------------------------------------------------------------ task and break windows


def task_windows(events: DataFrame, session: Sequence[str], task: str, wall: str, clock: str, is_start: Column, is_finish: Column,
                 seq: str) -> DataFrame:
    """Task windows from markers, one row per (session, task).

    Start: first start marker, else the task's first event. End: last finish marker
    (by ``seq``) when it lies after the start, else the next task's start, else the
    session's last event. The clock offset is the session's median of wall - clock.
    """
    ok = events.filter(F.col(wall) >= 0)
    t = ok.filter(F.col(task).isNotNull()).groupBy(*session, task).agg(
        F.min_by(wall, F.when(is_start, F.col(seq))).alias("_s"), F.min_by(wall, seq).alias("_f"),
        F.max_by(wall, F.when(is_finish, F.col(seq))).alias("_e"),
    ).withColumn("start", F.coalesce("_s", "_f"))
    ends = ok.groupBy(*session).agg(F.max(wall).alias("_last"))
    off = ok.filter(F.col(clock) >= 0).withColumn("_off", F.col(wall) - F.col(clock))
    off = exact_percentiles(off, session, {"offset": ("_off", 0.5)})
    # a session has a handful of tasks
    w = Window.partitionBy(*session).orderBy(task)
    t = t.withColumn("_next", F.lead("start").over(w))
    t = join_on(join_on(t, ends, session, "left"), off, session, "left")
    end = F.when(F.col("_e") > F.col("start"), F.col("_e")).otherwise(F.coalesce("_next", "_last"))
    t = t.withColumn("end", end).filter(F.col("end") > F.col("start"))
    return t.select(*session, task, "start", "end", (F.col("end") - F.col("start")).alias("duration"), "offset",
                    (F.col("start") - F.col("offset")).alias("start_clock"), (F.col("end") - F.col("offset")).alias("end_clock"))


def break_windows(tasks: DataFrame, span: DataFrame, keys: Sequence[str], task: str) -> DataFrame:
    """PRE, BREAK_a_b and POST windows around each session's ordered tasks.

    ``span`` gives session_start and session_end per key.
    """
    d = ordered_scan(tasks, keys, ["start"], {"_nt": next_(task), "_ns": next_("start"), "_no": row_no()})
    d = join_on(d, span.select(*keys, "session_start", "session_end"), keys, "left")
    pre = F.when(F.col("_no") == 1, F.struct(F.lit("PRE").alias("label"), F.col("session_start").alias("a"), F.col("start").alias("z")))
    gap = F.when(F.col("_nt").isNotNull(), F.struct(
        F.concat(F.lit("BREAK_"), F.col(task), F.lit("_"), F.col("_nt")).alias("label"), F.col("end").alias("a"), F.col("_ns").alias("z")))
    post = F.when(F.col("_nt").isNull(), F.struct(F.lit("POST").alias("label"), F.col("end").alias("a"), F.col("session_end").alias("z")))
    d = d.select(*keys, F.explode(F.array_compact(F.array(pre, gap, post))).alias("_w"))
    return d.select(*keys, F.col("_w.label").alias("label"), F.col("_w.a").alias("start"), F.col("_w.z").alias("end")).filter(F.col("end") > F.col("start"))


def last_segment(df: DataFrame, keys: Sequence[str], order: Sequence, counter: str, slack: float = 0.5, rows_per_block: int | None = None) -> DataFrame:
    """Rows after the last reset of a counter (a drop of more than ``slack``)."""
    reset = F.when(F.col(counter) + slack < F.col("_p"), 1).otherwise(0)
    d = ordered_scan(df, keys, order, {"_p": prev(counter)}, rows_per_block, then=[({"_r": reset}, {"_seg": cum_sum("_r")})])
    d = with_stats(d, keys, {"_lastseg": F.max("_seg")})
    return d.filter(F.col("_seg") == F.col("_lastseg")).drop("_p", "_r", "_seg", "_lastseg")


