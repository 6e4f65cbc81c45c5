"""Joins between streams, people, groups and expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gatherline.functions.exprs import col
from gatherline.operators.intervals import asof_join, overlap_join, within_join
from gatherline.operators.ordered import cum_max_before, join_on, next_, ordered_scan, prev, row_no, top_row


def join_modalities(tables: Sequence[DataFrame], keys: Sequence[str], shared: Sequence[str] = (), how: str = "full") -> DataFrame:
    """Window tables joined on their keys; a column every side carries (``shared``) is coalesced.

    Each side must already be at one row per key, so nothing fans out.
    """
    out = None
    for i, t in enumerate(tables):
        t = t.withColumnsRenamed({c: f"_{c}{i}" for c in shared if c in t.columns})
        out = t if out is None else out.join(t, list(keys), how)
    have = {c: [f"_{c}{i}" for i in range(len(tables)) if f"_{c}{i}" in out.columns] for c in shared}
    merged = {c: F.coalesce(*[F.col(x) for x in xs]) for c, xs in have.items()}
    return out.withColumns(merged).drop(*[x for xs in have.values() for x in xs])


def enrich(base: DataFrame, *sides: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Successive left joins; sizes decide broadcast or shuffle at run time."""
    return reduce(lambda acc, s: acc.join(s[0], list(s[1]), "left"), sides, base)


def complete_cases(features: DataFrame, targets: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Inner join, then only rows with every listed column present."""
    return features.join(targets, list(keys), "inner").dropna(subset=list(cols))


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails at run time when the right side repeats a key."""
    rest = [c for c in right.columns if c not in keys]
    g = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_r"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("right side repeats key "), F.to_json(F.struct(*keys))))).otherwise(F.col("_r"))
    g = g.select(*keys, one.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return left.join(g, list(keys), how)


def expected_grid(sessions: DataFrame, factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every session with every combination of the listed factor levels (short literal lists)."""
    out = sessions.distinct()
    for name, levels in factors.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return out


def against_expected(grid: DataFrame, actual: DataFrame, keys: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join of the grid to what exists; ``missing`` marks absent cells."""
    out = join_on(grid, actual.withColumn("_here", F.lit(True)), keys, "left")
    out = out.withColumn("missing", F.col("_here").isNull()).drop("_here")
    return out.fillna(dict(fill)) if fill else out


def surrounding_segments(events: DataFrame, segments: DataFrame, keys: Sequence[str], event_id: str, onset: str, end: str,
                         payload: Sequence[str]) -> DataFrame:
    """The two segments around each event, as structs ``seg_a`` and ``seg_b``.

    Two or more overlap it: the first two by onset (ties by payload). One overlaps: the latest earlier
    segment and that one (it alone when nothing is earlier). None: the two latest earlier.

    No pair is formed to be dropped again. In order of onset, the first segment that ends after an event's onset is the
    first whose running latest end does, and the second is the first whose running second-latest end does; both
    rise along the stream, so a nearest-later lookup finds them among the rows where they rise.
    """
    pay = list(payload)
    seg = segments.select(*keys, onset, end, *pay).filter(F.col(onset).isNotNull())
    ev = events.select(*keys, event_id, onset, end)
    s = F.struct(onset, *pay)
    steps = {"_top": cum_max_before(end), "_pp": prev(s)}
    lesser = F.when(F.col("_top").isNotNull(), F.least(F.col(end), F.col("_top")))
    d = ordered_scan(seg, keys, [onset, *pay], steps, then=[({"_b": lesser}, {"_second": cum_max_before("_b")})]).withColumn("_ps", s)
    rise = lambda v, before: d.filter(F.col(v) > F.coalesce(F.col(before), F.lit(float("-inf")))).select(*keys, F.col(v).cast("double").alias("_until"), "_ps")
    near = asof_join(ev, d.select(*keys, onset, "_ps", "_pp"), keys, onset, onset, ["_ps", "_pp"], "backward", prefix="e_", strict=True)
    one = asof_join(near, rise(end, "_top"), keys, onset, "_until", ["_ps"], "forward", prefix="f_", strict=True)
    two = asof_join(one, rise("_b", "_second"), keys, onset, "_until", ["_ps"], "forward", prefix="g_", strict=True)
    reached = lambda c: F.when(F.col(f"{c}.{onset}") < F.col(end), F.col(c))
    around = two.select(*keys, event_id, F.col("e__ps").alias("_e1"), F.col("e__pp").alias("_e2"), reached("f__ps").alias("_o1"), reached("g__ps").alias("_o2"))
    m = join_on(events, around, [*keys, event_id], "left")
    o1, o2, e1, e2 = F.col("_o1"), F.col("_o2"), F.col("_e1"), F.col("_e2")
    both_earlier = e1.isNotNull() & e2.isNotNull()
    a = F.when(o2.isNotNull(), o1).when(o1.isNotNull(), F.coalesce(e1, o1)).when(both_earlier, e2)
    b = F.when(o2.isNotNull(), o2).when(o1.isNotNull(), F.when(e1.isNotNull(), o1)).when(both_earlier, e1)
    return m.withColumns({"seg_a": a, "seg_b": b}).drop("_o1", "_o2", "_e1", "_e2")


def follow_ups(first: DataFrame, second: DataFrame, keys: Sequence[str], onset: str, end: str, speaker: str, max_gap: float,
               width: float, prefix: str = "b_") -> DataFrame:
    """Second rows of another speaker that start in [onset, end + max_gap] of a first row."""
    ranges = first.withColumn("_until", F.col(end) + F.lit(float(max_gap)))
    pts = second.select(*keys, *[F.col(c).alias(prefix + c) for c in second.columns if c not in keys])
    return within_join(pts, ranges, keys, prefix + onset, (onset, "_until"), width, closed=True,
                       extra=F.col(speaker) != F.col(prefix + speaker)).drop("_until")


def resample_grid(df: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str], step: float, tolerance: float,
                  rows_per_block: int | None = None) -> DataFrame:
    """Nearest sample on a fixed grid from each stream's first to last sample; is_missing beyond the tolerance."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    n = F.floor((F.col("_z") - F.col("_a")) / F.lit(float(step)))
    grid = span.withColumn("grid_index", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    grid = grid.withColumn("grid_t", F.col("_a") + F.col("grid_index") * F.lit(float(step))).drop("_a", "_z")
    out = asof_join(grid, df, keys, "grid_t", t, payload, "nearest", tolerance, rows_per_block=rows_per_block)
    return out.withColumn("is_missing", F.col("m_t").isNull())


def context_text(events: DataFrame, segments: DataFrame, keys: Sequence[str], event_id: str, onset: str, end: str, text: str,
                 reach: float, width: float, mark: Column | None = None, sep: str = " | ") -> DataFrame:
    """Text of all segments within ``reach`` of an event, in time order, joined into one string."""
    ev = events.select(*keys, event_id, (F.col(onset) - reach).alias("_a"), (F.col(end) + reach).alias("_z"))
    j = overlap_join(ev, segments, keys, ("_a", "_z"), (onset, end), width)
    shown = F.col(f"r_{text}") if mark is None else mark
    parts = F.array_sort(F.collect_list(F.struct(F.col(f"r_{onset}").alias("o"), shown.alias("x"))))
    return j.groupBy(*keys, event_id).agg(F.array_join(F.transform(parts, lambda p: p["x"]), sep).alias("context"),
                                          F.count(F.lit(1)).alias("n_segments"))


def piecewise_clock(df: DataFrame, segments: DataFrame, keys: Sequence[str], t: str, out: str, rows_per_block: int | None = None) -> DataFrame:
    """scale * t + offset of the clock segment in force; before the first one, the first is used.

    ``segments`` has keys, t0, scale, offset.
    """
    cols = df.columns
    first = top_row(segments.select(*keys, "t0", "scale", "offset"), keys, F.col("t0"), largest=False)
    m = asof_join(df, segments, keys, t, "t0", ["scale", "offset"], "backward", rows_per_block=rows_per_block)
    m = join_on(m, first.select(*keys, F.col("scale").alias("_fs"), F.col("offset").alias("_fo")), keys, "left")
    mapped = F.coalesce(F.col("m_scale"), F.col("_fs")) * F.col(t) + F.coalesce(F.col("m_offset"), F.col("_fo"))
    return m.select(*cols, mapped.alias(out))


def peer_mean(ratings: DataFrame, keys: Sequence[str], rater: str, rated: str, value: str) -> DataFrame:
    """Mean rating each member got from the others (self ratings left out)."""
    return ratings.filter(F.col(rater) != F.col(rated)).groupBy(*keys, rated).agg(
        F.avg(value).alias("peer_mean"), F.count(value).alias("n_ratings"))


def cross_member_similarity(df: DataFrame, keys: Sequence[str], member: str, vec: str) -> DataFrame:
    """Mean cosine over all pairs of rows from different members in a window, without forming pairs.

    Rows with a zero vector have no direction and take no part.

    For unit vectors the pair sum is (|sum|^2 - sum over members |their sum|^2) / 2, so
    per-dimension sums are enough: they combine on the map side.
    """
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.select(*keys, member, F.posexplode(v).alias("_d", "_x"), norm.alias("_n")).filter(F.col("_n") > 0).withColumn("_x", F.col("_x") / F.col("_n"))
    m = unit.groupBy(*keys, member, "_d").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_c"))
    d = m.groupBy(*keys, "_d").agg(F.sum("_s").alias("_t"), F.sum(F.col("_s") * F.col("_s")).alias("_q"),
                                   F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_nn"))
    g = d.groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") - F.col("_q")).alias("_num"), F.max(F.col("_n") * F.col("_n") - F.col("_nn")).alias("_den"))
    return g.select(*keys, (F.col("_den") / 2).cast("long").alias("n_pairs"), F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).alias("similarity"))


def best_shift(df: DataFrame, a: tuple[str, str], b: tuple[str, str], shifts: Sequence[int], unit: float) -> DataFrame:
    """Whole-unit shift of span b that overlaps span a most; ties go to the smallest shift."""
    best = None
    cand = F.transform(F.array(*[F.lit(int(s)) for s in shifts]), lambda s: F.struct(
        F.greatest(F.lit(0.0), F.least(F.col(a[1]), F.col(b[1]) + s * F.lit(float(unit))) - F.greatest(F.col(a[0]), F.col(b[0]) + s * F.lit(float(unit)))).alias("overlap"),
        (-F.abs(s)).alias("near"), (-s).alias("neg")))
    best = F.array_max(cand)
    return df.withColumn("_b", best).withColumns({"shift": -F.col("_b.neg"), "overlap": F.col("_b.overlap")}).drop("_b")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], col_name: str, as_set: str | None = None) -> DataFrame:
    """OK, DIFF, LEFT_ONLY, RIGHT_ONLY or EMPTY per key; ``as_set`` splits values before comparing."""
    l = left.select(*keys, F.col(col_name).alias("left_value"), F.lit(True).alias("_l"))
    r = right.select(*keys, F.col(col_name).alias("right_value"), F.lit(True).alias("_r"))
    j = l.join(r, list(keys), "full")
    a, b = F.col("left_value"), F.col("right_value")
    if as_set:
        xs, ys = F.split(a, as_set), F.split(b, as_set)
        same = (F.size(F.array_except(xs, ys)) == 0) & (F.size(F.array_except(ys, xs)) == 0)
    else:
        same = a == b
    status = (
        F.when(F.col("_l").isNull(), "RIGHT_ONLY").when(F.col("_r").isNull(), "LEFT_ONLY")
        .when(a.isNull() & b.isNull(), "EMPTY").when(F.coalesce(same, F.lit(False)), "OK").otherwise("DIFF")
    )
    return j.withColumn("status", status).drop("_l", "_r")


# ------------------------------------------------------------------ crosswalk


def _norm_name(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def _edits(length: Column, cutoff: float, blocks: bool) -> Column:
    """Most edits a partner of a string of this length may need at the cutoff; from its length on, one piece is empty and meets all."""
    most = F.floor(length * F.lit((1 - cutoff) / cutoff * (2 if blocks else 1)) + F.lit(1e-9))
    return F.least(most, length).cast("int")


@F.pandas_udf(DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the recursively longest common blocks, ``b`` first."""
    m, out, last = SequenceMatcher(), [], None
    for x, y in zip(a, b, strict=True):
        if x != last:
            m.set_seq2(x)
            last = x
        m.set_seq1(y)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def _piece(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of piece i when a string is cut into k + 1 even pieces."""
    a = F.floor(length * i / (k + 1)).cast("int")
    z = F.floor(length * (i + 1) / (k + 1)).cast("int")
    return a, z - a


def fuzzy_pairs(a: DataFrame, b: DataFrame, cutoff: float, blocks: bool = False) -> DataFrame:
    """Pairs (a_name, b_name) of distinct names whose similarity reaches the cutoff, exactly.

    The similarity is 1 - edits / longer length, or, with ``blocks``, twice the characters in the recursively
    longest common blocks over both lengths. A name within k edits keeps at least one of k + 1 pieces of its
    partner, moved by at most k places: only names sharing such a piece are compared. What is outside the
    blocks is at most k = (1 - cutoff) * (both lengths) insertions and deletions, so the same holds there.
    At low cutoffs k reaches the length and all names of fitting lengths are compared.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff must be in (0, 1]")
    lb = F.length("b_name")
    kb = _edits(lb, cutoff, blocks)

    def b_sig(i):
        s, n = _piece(lb, kb, i)
        return F.concat_ws(":", lb.cast("string"), i.cast("string"), F.substr(F.col("b_name"), s + 1, n))

    bs = b.select("b_name", F.explode(F.transform(F.sequence(F.lit(0), kb), b_sig)).alias("sig"))
    la = F.length("a_name")

    def pieces(l):
        k = _edits(l, cutoff, blocks)

        def at(i):
            s, n = _piece(l, k, i)
            lo, hi = F.greatest(F.lit(0), s - k), F.least(la - n, s + k)
            moves = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
            return F.transform(moves, lambda q: F.concat_ws(":", l.cast("string"), i.cast("string"), F.substr(F.col("a_name"), q + 1, n)))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), at))

    shortest = cutoff / (2 - cutoff) if blocks else cutoff
    lens = F.sequence(F.ceil(la * F.lit(shortest) - F.lit(1e-9)).cast("int"), F.floor(la / F.lit(shortest) + F.lit(1e-9)).cast("int"))
    sigs = F.array_distinct(F.flatten(F.transform(lens, pieces)))
    as_ = a.filter(la > 0).select("a_name", F.explode(sigs).alias("sig"))
    p = as_.join(bs, "sig").select("a_name", "b_name").distinct()
    ratio = _block_ratio("a_name", "b_name") if blocks else 1 - F.levenshtein("a_name", "b_name") / F.greatest(F.length("a_name"), F.length("b_name"))
    return p.withColumn("similarity", ratio).filter(F.col("similarity") >= cutoff - 1e-9)


def crosswalk(names: DataFrame, name: str, canon: DataFrame, canon_name: str, cutoff: float = 0.8, blocks: bool = False) -> DataFrame:
    """Match names to a canonical list: normalised exact first, then the closest at or over the cutoff.

    Adds ``matched`` ('n/a' when none) and ``outcome`` exact / fuzzy / none. Similarity is
    one minus edits over the longer length, ties take the smaller name; or that of common ``blocks``,
    ties take the larger name. Only distinct names are compared, so repeats of a name cost nothing.
    """
    d = names.withColumn("_a", _norm_name(name))
    cb = canon.select(_norm_name(canon_name).alias("b_name")).distinct()
    da = d.select(F.col("_a").alias("a_name")).distinct()
    exact = da.join(cb, da["a_name"] == cb["b_name"], "left_semi").select("a_name", F.col("a_name").alias("matched"), F.lit("exact").alias("outcome"))
    rest = da.join(cb, da["a_name"] == cb["b_name"], "left_anti")
    pairs = fuzzy_pairs(rest, cb, cutoff, blocks)
    closest = F.max(F.struct("similarity", "b_name")) if blocks else F.min(F.struct((-F.col("similarity")).alias("s"), "b_name"))
    best = pairs.groupBy("a_name").agg(closest.alias("m"))
    fuzzy = best.select("a_name", F.col("m.b_name").alias("matched"), F.lit("fuzzy").alias("outcome"))
    key = exact.unionByName(fuzzy)
    out = d.join(key, d["_a"] == key["a_name"], "left").drop("_a", "a_name")
    return out.withColumns({"matched": F.coalesce("matched", F.lit("n/a")), "outcome": F.coalesce("outcome", F.lit("none"))})


def outcome_counts(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many names of a crosswalk were matched exactly, by likeness and not at all."""
    return matched.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("exact", "fuzzy", "none")])
