"""Sinks: partitioned parquet, readable TSV, run metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def write_feature_table(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> None:
    """Parquet by session and task. Rows spread over the sort columns too, so one big
    session becomes several files instead of one task."""
    out = df
    if sort_by:
        out = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(*partition_by, *sort_by)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_tsv(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> None:
    """Tab separated text in global order (a range shuffle, not a single task)."""
    out = df.orderBy(*sort_by) if sort_by else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_metadata(spark: SparkSession, path: str, meta: Mapping) -> None:
    """Seed, inputs, feature lists and the like as a one-row JSON table."""
    row = [(json.dumps(dict(meta), sort_keys=True, default=str),)]
    spark.createDataFrame(row, "metadata string").write.mode("overwrite").text(path)
