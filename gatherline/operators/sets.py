"""Set operations between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(tables: Mapping[str, tuple[DataFrame, Mapping[str, str]]], source: str = "source") -> DataFrame:
    """UNION ALL by name after renaming; a column one side lacks is null there."""
    parts = [
        df.select(*[F.col(a).alias(b) for a, b in names.items()]).withColumn(source, F.lit(tag)) for tag, (df, names) in tables.items()
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def missing_from(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that do not occur."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), list(keys), "left_anti")


def present_in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
