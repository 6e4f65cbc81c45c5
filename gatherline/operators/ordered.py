"""Ordered per-key computations that survive a hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here every
input is sampled first, at the same rate whatever its size: about SAMPLES rows of a
block's worth. Keys with that many sampled rows are cut at every SAMPLES-th of them,
in the whole order (ties of the first order column included), so blocks follow the
quantiles of the key and a burst or a few outliers do not fill one. Rows are shuffled
once, by key and block, and windowed there; what one block must know about its
neighbours (last row, running sum, ...) travels as one small carry row per block.

The table of cuts has one entry per ``rows_per_block`` rows and the carries one row
per block; both are that much smaller than the input and are broadcast. Where no key
is cut there is nothing to carry and the carry join is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.session import materialise, stored

ROWS_PER_BLOCK = 2_000_000
#: Rows that a task holds where the rows are dealt by their number.
ROWS_PER_TASK = 250_000
#: Sampled rows between two cuts.
SAMPLES = 20
#: Share of a key's values that the first pass of a percentile may be off by; keys with up to 1 / RANK_ERROR values skip nothing.
RANK_ERROR = 1e-4

ColumnLike = str | Column


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Step:
    kind: str
    expr: object = None


def prev(expr: ColumnLike) -> Step:
    """Value of the row before."""
    return Step("prev", _c(expr))


def next_(expr: ColumnLike) -> Step:
    """Value of the row after."""
    return Step("next", _c(expr))


def last_valid(expr: ColumnLike) -> Step:
    """Latest non-null value up to and including this row."""
    return Step("last_valid", _c(expr))


def last_valid_before(expr: ColumnLike) -> Step:
    """Latest non-null value strictly before this row."""
    return Step("last_valid_before", _c(expr))


def next_valid(expr: ColumnLike) -> Step:
    """Earliest non-null value from this row on."""
    return Step("next_valid", _c(expr))


def cum_sum(expr: ColumnLike) -> Step:
    return Step("cum_sum", _c(expr))


def cum_max(expr: ColumnLike) -> Step:
    return Step("cum_max", _c(expr))


def cum_max_before(expr: ColumnLike) -> Step:
    """Running maximum of the rows strictly before this one."""
    return Step("cum_max_before", _c(expr))


def rev_min(expr: ColumnLike) -> Step:
    """Minimum over this row and all later ones."""
    return Step("rev_min", _c(expr))


def row_no() -> Step:
    return Step("row_no", F.lit(1))


def key_sum(expr: ColumnLike) -> Step:
    """Sum over the whole key."""
    return Step("key_sum", _c(expr))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def cuts_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int) -> DataFrame | None:
    """(_hot0.., _cuts, _heads): the places where keys are cut along ``order``, or None where no key is.

    ``_heads`` are every k-th of k * k cuts, so that a row finds its block in some 2 k steps.
    """
    rate = min(1.0, SAMPLES / rows_per_block)
    per = max(1, round(rate * rows_per_block))
    hot = [f"_hot{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(h) for k, h in zip(keys, hot)], F.struct(*order).alias("_o"))
    if rate < 1:
        rows = rows.sample(rate, 17)
    every = lambda c, step: F.transform(F.sequence(step, F.size(c), step), lambda i: F.element_at(c, i))
    cut = (
        rows.groupBy(*hot).agg(F.sort_array(F.collect_list("_o")).alias("_s")).filter(F.size("_s") > per)
        .select(*hot, F.array_distinct(every(F.col("_s"), F.lit(per))).alias("_cuts"))
        .withColumn("_step", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
    )
    step = F.col("_step")
    heads = F.when(step <= F.size("_cuts"), every(F.col("_cuts"), step)).otherwise(F.slice("_cuts", 1, 0))
    found = cut.select(*hot, "_cuts", "_step", heads.alias("_heads"))
    table = found.toArrow()  # one entry per block
    return df.sparkSession.createDataFrame(table, found.schema) if table.num_rows else None


def with_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add ``_blk``: -1 for keys kept whole, else the number of the key's cuts at or before the row."""
    hot = [f"_hot{i}" for i in range(len(keys))]
    at = F.struct(*order)
    upto = lambda c: F.size(F.filter(c, lambda x: x <= F.col("_cut_at")))
    d = df.join(F.broadcast(cuts), _same(keys, hot), "left").withColumn("_cut_at", F.when(F.col("_cuts").isNotNull(), at))
    d = d.withColumn("_cut_h", F.when(F.col("_cuts").isNotNull(), upto(F.col("_heads")) * F.col("_step")))
    blk = F.when(F.col("_cuts").isNull(), -1).otherwise(F.col("_cut_h") + upto(F.slice("_cuts", F.col("_cut_h") + 1, F.col("_step"))))
    return d.withColumn("_blk", blk.cast("long")).drop(*hot, "_cuts", "_step", "_heads", "_cut_at", "_cut_h")


def parts_of(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks the rows fill, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read to the shared folder, so it is computed once."""
    return stored(df)[0]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnLike],
    steps: dict[str, Step],
    rows_per_block: int | None = None,
    then: Sequence[tuple[dict[str, Column], dict[str, Step]]] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add one column per step, computed along ``order`` (ascending, nulls first) within ``keys``.

    ``order`` should be total: rows alike in all of it stay in one block. ``then`` lists
    further rounds (columns derived from the steps so far, next steps); they share the cuts
    and, where no key is cut, the shuffle of the first round. ``parts``: into how many tasks
    the rows are dealt, where the caller knows how much they hold.
    """
    names = list(df.columns)
    cur = df
    keys = list(keys)
    if not keys:
        cur, keys = cur.withColumn("_all", F.lit(0)), ["_all"]
    onames = [f"_o{i}" for i in range(len(order))]
    cur = cur.withColumns({n: _c(o) for n, o in zip(onames, order)})
    cuts = cuts_of(cur, keys, onames, rows_per_block or ROWS_PER_BLOCK)
    if cuts is not None:
        cur = with_blocks(cur, keys, onames, cuts)
    if parts:
        cur = cur.repartition(parts, *keys, *(["_blk"] if cuts is not None else []))
    rounds = [({}, steps), *then]
    for i, (derived, st) in enumerate(rounds):
        if derived:
            cur = cur.withColumns(derived)
        names += [n for n in [*derived, *st] if n not in names]
        cur = _scan_round(cur, keys, onames, st, cuts is not None)
        if cuts is not None and i + 1 < len(rounds):
            cur = materialise(cur)  # read twice by the next round
    return cur.select(*names)


def _scan_round(df: DataFrame, keys: list[str], onames: list[str], steps: dict[str, Step], split: bool) -> DataFrame:
    base = df.withColumns({f"_in{i}": s.expr for i, s in enumerate(steps.values())})
    part = Window.partitionBy(*keys, "_blk") if split else Window.partitionBy(*keys)
    w = part.orderBy(*onames)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # frames that run to the end cost a pass per row in Spark; the reversed order needs one pass in all
    onward = part.orderBy(*[F.col(o).desc_nulls_last() for o in onames]).rowsBetween(Window.unboundedPreceding, 0)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.struct(*onames)

    by_block = Window.partitionBy(*keys).orderBy("_blk")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy(*keys)

    local, summary, carry, final = {}, {}, {}, {}
    for i, (name, s) in enumerate(steps.items()):
        l, z = f"_l{i}", f"_z{i}"
        e, lc, zc = F.col(f"_in{i}"), F.col(l), F.col(z)
        if s.kind == "prev":
            local[l], summary[z] = F.lag(e).over(w), F.max_by(e, rank)
            carry[z] = F.lag(zc).over(by_block)
            final[name] = F.when(F.col("_first"), zc).otherwise(lc)
        elif s.kind == "next":
            local[l], summary[z] = F.lead(e).over(w), F.min_by(e, rank)
            carry[z] = F.lead(zc).over(by_block)
            final[name] = F.when(F.col("_last"), zc).otherwise(lc)
        elif s.kind in ("last_valid", "last_valid_before"):
            local[l] = F.last(e, ignorenulls=True).over(upto if s.kind == "last_valid" else before)
            summary[z] = F.max_by(e, F.when(e.isNotNull(), rank))
            carry[z] = F.last(zc, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(lc, zc)
        elif s.kind == "next_valid":
            local[l] = F.last(e, ignorenulls=True).over(onward)
            summary[z] = F.min_by(e, F.when(e.isNotNull(), rank))
            carry[z] = F.last(zc, ignorenulls=True).over(later)
            final[name] = F.coalesce(lc, zc)
        elif s.kind in ("cum_sum", "row_no"):
            local[l], summary[z] = F.sum(e).over(upto), F.sum(e)
            carry[z] = F.sum(zc).over(earlier)
            final[name] = F.coalesce(lc + zc, lc, zc)
        elif s.kind in ("cum_max", "cum_max_before"):
            local[l], summary[z] = F.max(e).over(upto if s.kind == "cum_max" else before), F.max(e)
            carry[z] = F.max(zc).over(earlier)
            final[name] = F.greatest(lc, zc)
        elif s.kind == "rev_min":
            local[l], summary[z] = F.min(e).over(onward), F.min(e)
            carry[z] = F.min(zc).over(later)
            final[name] = F.least(lc, zc)
        elif s.kind == "key_sum":
            local[l], summary[z] = F.sum(e).over(whole), F.sum(e)
            carry[z] = F.sum(zc).over(all_blocks)
            final[name] = F.coalesce(zc, lc)
        else:
            raise ValueError(s.kind)
    keep = [c for c in df.columns if c not in final]
    if not split:
        rows = base.withColumns(local)
        return rows.select(*keep, *[F.col(f"_l{i}").alias(n) for i, n in enumerate(steps)])
    kinds = {s.kind for s in steps.values()}
    if "prev" in kinds:
        local["_first"] = (F.row_number().over(w) == 1) & (F.col("_blk") >= 0)
    if "next" in kinds:
        local["_last"] = F.lead(F.lit(1)).over(w).isNull() & (F.col("_blk") >= 0)
    rows = base.withColumns(local)
    carries = (
        base.filter(F.col("_blk") >= 0)
        .groupBy(*keys, "_blk")
        .agg(*[v.alias(k) for k, v in summary.items()])
        .select(
            *[F.col(k).alias(f"_ck{i}") for i, k in enumerate(keys)],
            F.col("_blk").alias("_cb"),
            *[v.alias(k) for k, v in carry.items()],
        )
    )
    cond = _same(keys, [f"_ck{i}" for i in range(len(keys))]) & (F.col("_blk") == F.col("_cb"))
    out = rows.join(F.broadcast(carries), cond, "left")  # one row per block
    return out.select(*keep, *[v.alias(k) for k, v in final.items()])


# ---------------------------------------------------------------- ranks, quantiles


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """One row per (keys, value): ``n``, ``min_rank``, ``avg_rank``, ``cum`` and key total ``total``.

    Rows are collapsed to distinct values first, so ties never pile up in a task.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    r = ordered_scan(counts, keys, [value], {"cum": cum_sum("n"), "total": key_sum("n")}, rows_per_block)
    return r.withColumns(
        {
            "min_rank": F.col("cum") - F.col("n") + 1,
            "avg_rank": F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0,
        }
    )


def unpivot_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (keys, feature, value double)."""
    # each value sits in its own column, so a key may be among the columns
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keys, F.inline(cells))


def _bracketed(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], cells: Sequence[tuple[str, float]]) -> DataFrame:
    """First pass: per key ``aggs`` and, for each cell (column, fraction), ``_n{i}``, ``_lo{i}`` and ``_hi{i}``: how many
    values there are and two that the wanted ones lie between. A quantile sketch gives them, so the pass holds no key's
    values; keys with few values are bracketed by their least and largest."""
    few = round(1 / RANK_ERROR)
    accuracy, margin = F.lit(few), 3 * RANK_ERROR
    fractions: dict[str, list[float]] = {}
    for c, p in cells:
        fractions.setdefault(c, []).append(p)
    col = {c: F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))) for c in fractions}  # not-a-number sorts last
    got = {c: F.percentile_approx(col[c], [min(1.0, max(0.0, p + s * margin)) for p in ps for s in (-1, 1)], accuracy) for c, ps in fractions.items()}
    held = [x for i, c in enumerate(fractions) for x in (F.count(col[c]).alias(f"_c{i}"), F.min(col[c]).alias(f"_a{i}"), F.max(col[c]).alias(f"_z{i}"), got[c].alias(f"_q{i}"))]
    g = df.groupBy(*keys).agg(*aggs, *held)
    nth = {c: i for i, c in enumerate(fractions)}
    out = {}
    for i, (c, p) in enumerate(cells):
        k, at = nth[c], 2 * fractions[c].index(p)
        small = F.col(f"_c{k}") <= few
        out[f"_n{i}"] = F.col(f"_c{k}")
        out[f"_lo{i}"] = F.when(small, F.col(f"_a{k}")).otherwise(F.get(f"_q{k}", F.lit(at)))
        out[f"_hi{i}"] = F.when(small, F.col(f"_z{k}")).otherwise(F.get(f"_q{k}", F.lit(at + 1)))
    extra = [c for k in range(len(fractions)) for c in (f"_c{k}", f"_a{k}", f"_z{k}", f"_q{k}")]
    return g.withColumns(out).drop(*extra)


def agg_with_percentiles(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], spec: dict[str, tuple[str, float]]) -> DataFrame:
    """Aggregates plus exact interpolated percentiles ``{out: (column, fraction)}`` per key, in two passes.

    The first pass brackets each wanted rank (``_bracketed``). The second counts the values below each bracket and the
    distinct values inside it, some ten-thousandth of a large key, and picks the wanted ones from running counts. A rank outside
    its bracket, which the sketch's bound excludes, would stop the query. Nulls are left out; a key without values has nulls.
    """
    flat = not keys
    if flat:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    cells = list(dict.fromkeys((c, float(p)) for c, p in spec.values()))
    first = settle(_bracketed(df, keys, aggs, cells))
    marks = [f"{x}{i}" for i in range(len(cells)) for x in ("_n", "_lo", "_hi")]
    near = join_on(df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(dict.fromkeys(c for c, _ in cells))]), first.select(*keys, *marks), keys, "inner")
    value = {c: F.col(f"_v{i}") for i, c in enumerate(dict.fromkeys(c for c, _ in cells))}
    each = []
    for i, (c, _) in enumerate(cells):
        v = value[c]
        x = F.nanvl(v, F.lit(float("inf")))
        cell = F.struct(F.lit(i).alias("_i"), F.col(f"_n{i}").alias("_n"), F.when(x >= F.col(f"_lo{i}"), v).alias("_v"))
        each.append(F.when(x <= F.col(f"_hi{i}"), cell))
    counts = near.select(*keys, F.inline(F.array_compact(F.array(*each)))).groupBy(*keys, "_i", "_n", "_v").agg(F.count(F.lit(1)).alias("_w"))
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_cum", F.sum("_w").over(upto)).withColumn("_at", F.get(F.lit([p for _, p in cells]), F.col("_i")) * (F.col("_n") - 1))
    pick = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    low, high, at = pick(F.floor("_at")), pick(F.ceil("_at")), F.max("_at")
    below = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_cum"))), F.lit(0))
    inside = (below <= F.floor(at)) & (F.max("_cum") > F.ceil(at))
    got = ranked.groupBy(*keys, "_i").agg(
        F.when(inside, low + F.when(high == low, 0.0).otherwise((high - low) * (at - F.floor(at)))).otherwise(F.raise_error(F.lit("a rank left its bracket")).cast("double")).alias("_p")
    )
    place = {cell: i for i, cell in enumerate(cells)}
    picked = got.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == place[c, float(p)], F.col("_p"))).alias(o) for o, (c, p) in spec.items()])
    out = join_on(first.drop(*marks), picked, keys, "left")
    return out.drop("_all") if flat else out


def exact_percentiles(df: DataFrame, keys: Sequence[str], spec: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of several columns per key: ``{out: (column, fraction)}``."""
    return agg_with_percentiles(df, keys, [], spec)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join on shared key names; keeps the left keys (right's for unmatched in full).

    Left keys that are never null are joined by plain equality, so rows that were dealt by them stay where they are.
    """
    if not keys:
        raise ValueError("join_on needs keys")
    if list(keys) == ["_all"] and how in ("left", "inner"):
        # one constant key: the right side is a one-row summary
        cols = [c for c in right.columns if c != "_all"]
        out = left.withColumn("_s", right.select(F.struct(*cols).alias("s")).scalar())
        return out.withColumns({c: F.col(f"_s.{c}") for c in cols}).drop("_s")
    rk = [f"_rk{i}" for i in range(len(keys))]
    r = right
    for k, n in zip(keys, rk):
        r = r.withColumnRenamed(k, n)
    if how in ("left", "inner"):
        never = {f.name for f in left.schema.fields if not f.nullable}
        if never.issuperset(keys):
            return left.join(r, [F.col(k) == F.col(n) for k, n in zip(keys, rk)], how).drop(*rk)
    return left.join(r, _same(keys, rk), how).drop(*rk)


def median_of(df: DataFrame, keys: Sequence[str], col: str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, keys, {name: (col, 0.5)})


def top_row(df: DataFrame, keys: Sequence[str], by: Column, largest: bool = True) -> DataFrame:
    """The whole row with the largest (or smallest) ``by`` per key, without a sort per key."""
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    s = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_r"))
    return s.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
