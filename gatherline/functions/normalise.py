"""Folding of free-text answers into categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatherline.functions.exprs import col


def fold(c, rules: dict[str, str], keep: str = "lower", missing: str = "n/a") -> Column:
    """First category whose token occurs in the text; otherwise the text itself."""
    t = F.trim(col(c))
    low = F.lower(t)
    out = F.when(t.isNull() | (t == ""), missing)
    for token, label in rules.items():
        out = out.when(low.contains(token), label)
    return out.otherwise(low if keep == "lower" else t)


# fixed values: tokens in order of precedence
SEX = {"female": "female", "male": "male"}
HAND = {"right": "right", "left": "left", "ambid": "ambidextrous"}
EDUCATION = {
    "phd": "phd", "doctorate": "phd", "master": "master", "bachelor": "bachelor", "professional": "professional_certificate",
    "diploma": "professional_certificate", "graduate certificate": "graduate_certificate",
}


def age_text(exact, band) -> Column:
    """Whole years, else the middle of a band such as 25-34 or 65+, else n/a."""
    number = F.trim(col(exact).cast("string")).try_cast("double").cast("int")
    b = F.trim(col(band))
    lo, hi = F.regexp_extract(b, r"^(\d+)-(\d+)$", 1), F.regexp_extract(b, r"^(\d+)-(\d+)$", 2)
    open_end = F.regexp_extract(b, r"^(\d+)\+$", 1)
    mid = F.when(lo != "", F.floor((lo.try_cast("int") + hi.try_cast("int")) / 2).cast("int")).when(open_end != "", open_end.try_cast("int"))
    return F.coalesce(number.cast("string"), mid.cast("string"), F.lit("n/a"))
