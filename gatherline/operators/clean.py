"""Row-level cleaning, gating, labelling and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.functions.exprs import in_range, row_mean, score_label
from gatherline.operators.groups import baseline_z, z_within
from gatherline.operators.ordered import join_on


def plausibility_gate(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Null every listed column outside its (low, high) range."""
    return df.withColumns({c: in_range(c, lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def quality_gate(df: DataFrame, ok: Column, cols: Sequence[str]) -> DataFrame:
    """Null a block of columns on the rows where ``ok`` does not hold."""
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def reason_gate(df: DataFrame, reasons: Mapping[str, Column], cols: Sequence[str]) -> DataFrame:
    """One boolean column per reason; a row with any reason loses the listed values."""
    out = df.withColumns({f"bad_{k}": F.coalesce(v, F.lit(False)) for k, v in reasons.items()})
    hit = F.lit(False)
    for k in reasons:
        hit = hit | F.col(f"bad_{k}")
    return out.withColumns({c: F.when(~hit, F.col(c)) for c in cols})


def reason_counts(gated: DataFrame, reasons: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return gated.groupBy(*keys).agg(
        *[F.count_if(F.col(f"bad_{k}")).alias(f"n_{k}") for k in reasons], F.count(F.lit(1)).alias("n_rows")
    )


def candidate_columns(df: DataFrame, exclude: Sequence[str], bad_tokens: Sequence[str]) -> list[str]:
    """Numeric feature columns by type and name; a schema-only decision."""
    num = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, num) and f.name not in exclude and not any(t in f.name.lower() for t in bad_tokens)
    ]


def phase_filter(windows: DataFrame, timing: DataFrame, keys: Sequence[str], start: str, onset: str) -> DataFrame:
    """Drop windows that begin before the phase onset; rows without timing stay."""
    t = timing.groupBy(*keys).agg(F.min(onset).alias("_onset"))
    j = join_on(windows, t, keys, "left")
    return j.filter(F.col("_onset").isNull() | (F.col(start) >= F.col("_onset"))).drop("_onset")


def trim_to_active(df: DataFrame, keys: Sequence[str], index: str, active: Column) -> DataFrame:
    """Keep windows between the first and the last active one of each key."""
    span = df.filter(active).groupBy(*keys).agg(F.min(index).alias("_a"), F.max(index).alias("_z"))
    return join_on(df, span, keys, "inner").filter(F.col(index).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def one_hot(df: DataFrame, c: str, levels: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in levels})


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def widen(df: DataFrame, ids: Sequence[str], by: str, levels: Sequence, value: Column, fill=None) -> DataFrame:
    """Pivot with a stated level list, so the plan needs no extra pass to find the levels."""
    out = df.groupBy(*ids).pivot(by, list(levels)).agg(value)
    return out if fill is None else out.fillna(fill, [str(v) for v in levels])


def privacy_view(df: DataFrame, allow: Sequence[str], pseudonyms: Mapping[str, str] | None = None, salt: str = "") -> DataFrame:
    """Only allow-listed columns; ``pseudonyms`` maps a source column to a salted hash column."""
    hashes = [
        F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256).alias(new) for c, new in (pseudonyms or {}).items()
    ]
    return df.select(*hashes, *allow)


def composites(df: DataFrame, person: Sequence[str], task: str, signals: Mapping[str, str], baseline: str = "T0",
               within: Sequence[str] | None = None) -> DataFrame:
    """Load, arousal, attention, pressure, recovery and fatigue scores from signed z scores.

    ``signals`` names the columns for eda, scr, rate, rmssd, pupil, pupil_sd, missing, valid.
    With ``within`` the z scores are taken inside those keys (the window form); the
    recovery and fatigue scores belong to the task form only.
    """
    cols = list(dict.fromkeys(signals.values()))
    d = z_within(df, within, cols, "_q") if within else baseline_z(df, person, task, cols, baseline, "_q")
    z = {k: F.col(f"{c}_q") for k, c in signals.items()}
    arousal = row_mean([z["scr"], z["rate"], z["pupil_sd"]])
    new = {
        "cognitive_load": row_mean([z["pupil"], z["eda"], -z["rmssd"]]),
        "arousal": arousal,
        "attention": row_mean([z["valid"], -z["missing"], -z["pupil_sd"]]),
        "pressure": row_mean([arousal, z["eda"]]),
    }
    if not within:
        step = F.regexp_extract(F.col(task), r"(\d+)", 1).try_cast("int")
        new["recovery"] = row_mean([-z["eda"], -z["rate"], z["rmssd"]])
        new["fatigue"] = F.when(step >= 1, step * (-z["pupil"]) / 4.0)
    out = d.withColumns(new)
    return out.withColumns({
        "load_label": F.coalesce(score_label("cognitive_load"), F.lit("Unknown")),
        "arousal_label": F.coalesce(score_label("arousal"), F.lit("Unknown")),
    }).drop(*[f"{c}_q" for c in cols])


def gesture_flags(joints: DataFrame, keys: Sequence[str], min_conf: float, near_head: float, near_chest: float,
                  extended: float) -> DataFrame:
    """Seven gesture flags per (frame, person) from long joint rows (joint, x, y, z, conf).

    A side counts only when its shoulder, elbow and wrist reach ``min_conf``; a missing
    head or hip makes the distance unknown and the flag false.
    """
    names = ("nose", "mid_hip", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow", "l_wrist", "r_wrist")
    pick = [F.max(F.when(F.col("joint") == j, F.struct("x", "y", "z", "conf"))).alias(j) for j in names]
    w = joints.groupBy(*keys).agg(*pick)

    def dist(a, b):
        return F.sqrt(sum(((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) ** 2 for k in "xyz"), F.lit(0.0)))

    def sure(cond):
        return F.coalesce(cond, F.lit(False))

    flags = {}
    for side, full in (("l", "left"), ("r", "right")):
        sh, el, wr = (f"{side}_{j}" for j in ("shoulder", "elbow", "wrist"))
        valid = (F.col(f"{sh}.conf") >= min_conf) & (F.col(f"{el}.conf") >= min_conf) & (F.col(f"{wr}.conf") >= min_conf)
        path = dist(sh, el) + dist(el, wr)
        flags[f"{full}_hand_to_head"] = sure(valid & (dist(wr, "nose") <= near_head))
        flags[f"{full}_hand_to_chest"] = sure(valid & (dist(wr, "mid_hip") <= near_chest))
        flags[f"{full}_arm_extended"] = sure(valid & (path > 1e-6) & (dist(sh, wr) / path >= extended))
    flags["both_hands_to_head"] = flags["left_hand_to_head"] & flags["right_hand_to_head"]
    return w.select(*keys, *[v.alias(k) for k, v in flags.items()])
