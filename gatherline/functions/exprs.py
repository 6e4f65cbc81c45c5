"""Column expressions used across the operators. All of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(c) -> Column:
    """NaN is a value to Spark; here it means missing."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_number(c) -> Column:
    """Bad cells become null."""
    return no_nan(col(c).cast("string").try_cast("double"))


def in_range(c, low=None, high=None, sentinel_abs=None) -> Column:
    c = no_nan(c)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= F.lit(low))
    if high is not None:
        ok = ok & (c <= F.lit(high))
    if sentinel_abs is not None:
        ok = ok & (F.abs(c) < F.lit(sentinel_abs))
    return F.when(ok, c)


def pair_mean(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2.0).otherwise(F.coalesce(a, b))


def row_mean(parts: Sequence, at_least: int = 1) -> Column:
    """Mean of the non-null parts, null when fewer than ``at_least`` are there."""
    cs = [col(p) for p in parts]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.when(n >= at_least, total / n)


def score_label(c, high=1.0, low=-1.0, names=("High", "Low", "Moderate")) -> Column:
    c = col(c)
    return F.when(c >= high, names[0]).when(c <= low, names[1]).when(c.isNotNull(), names[2])


def flag_text(rules: Mapping[str, Column], sep: str = ";") -> Column:
    """Names of the rules that hold, in order, joined by ``sep``."""
    marks = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return F.array_join(F.array_compact(marks), sep)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def log_count(c) -> Column:
    return F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0)))


def loose_bool(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def group_label(c) -> Column:
    """grp8, grp-08, GRP_8 -> grp-08."""
    digits = F.regexp_extract(F.lower(col(c)), r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("grp-"), F.lpad(digits.cast("int").cast("string"), 2, "0")))


def ratio(a, b) -> Column:
    """a / b, null when b is 0 or null."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / b)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def jaccard(a, b) -> Column:
    """Share of common members of two sets; 0 when one is empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), F.size(F.array_intersect(col(a), col(b))) / union).otherwise(0.0)


def utc_text(seconds, fmt: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Epoch seconds as text; the session time zone should be UTC."""
    return F.date_format(F.timestamp_seconds(col(seconds)), fmt)


def zone_of(x, y, zones: Sequence[dict], default: str = "other") -> Column:
    """Name of the zone holding a point: lowest priority number first.

    A zone is {name, priority, cx, cy, r} or {name, priority, x0, x1, y0, y1}.
    """
    x, y = col(x), col(y)
    out = None
    for z in sorted(zones, key=lambda z: (z["priority"], z["name"])):
        if "r" in z:
            hit = (x - z["cx"]) * (x - z["cx"]) + (y - z["cy"]) * (y - z["cy"]) <= z["r"] * z["r"]
        else:
            hit = x.between(z["x0"], z["x1"]) & y.between(z["y0"], z["y1"])
        out = F.when(hit, z["name"]) if out is None else out.when(hit, z["name"])
    return out.otherwise(default)


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    ts = col(ts)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    in_day = F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60)
    micros = (F.extract(F.lit("SECOND"), ts) * F.lit(1000000)).cast("long")
    return (days * F.lit(86400) + in_day) * F.lit(1000000) + micros


def epoch_seconds(ts) -> Column:
    return epoch_micros(ts) / F.lit(1e6)
