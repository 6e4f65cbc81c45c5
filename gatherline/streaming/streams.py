"""Structured Streaming forms of the window, matching and run operators.

Late rows older than the watermark are dropped by Spark; results are written in
append mode, so a window appears once it is closed.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatherline.functions.exprs import epoch_micros
from gatherline.session import shared_dir


def read_events(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A stream over parquet files; ``event_time`` is the zone-less timestamp read as UTC."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("event_time", F.timestamp_micros(epoch_micros(ts)))


def tumbling(stream: DataFrame, keys: Sequence[str], width: str, late: str, aggs: Sequence[Column]) -> DataFrame:
    return _windowed(stream, keys, F.window("event_time", width), late, aggs)


def sliding(stream: DataFrame, keys: Sequence[str], width: str, step: str, late: str, aggs: Sequence[Column], start: str | None = None) -> DataFrame:
    """Sliding windows anchored at the epoch; ``start`` shifts the anchor."""
    return _windowed(stream, keys, F.window("event_time", width, step, start or "0 seconds"), late, aggs)


def _windowed(stream, keys, window, late, aggs):
    w = stream.withWatermark("event_time", late).groupBy(window.alias("w"), *keys).agg(*aggs)
    sec = lambda c: (F.unix_micros(c) / F.lit(1e6)).alias
    return w.select(*keys, sec(F.col("w.start"))("window_start"), sec(F.col("w.end"))("window_end"), *[c for c in w.columns if c not in (*keys, "w")])


def sessions(stream: DataFrame, keys: Sequence[str], gap: str, late: str, aggs: Sequence[Column]) -> DataFrame:
    """Sessions that end after ``gap`` without events."""
    return _windowed(stream, keys, F.session_window("event_time", gap), late, aggs)


def deduplicate(stream: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """Exact duplicates by key, as long as they arrive within the watermark of each other."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(list(keys))


def responses(first: DataFrame, second: DataFrame, keys: Sequence[str], within: str, late: str, extra: Column | None = None) -> DataFrame:
    """Stream-stream join: second rows at most ``within`` after a first row of the same key.

    Columns of the second stream get the prefix ``b_``. State is bounded by the range.
    """
    a = first.withWatermark("event_time", late)
    b = second.select(*[F.col(c).alias(f"b_{c}") for c in second.columns]).withWatermark("b_event_time", late)
    cond = (F.col("b_event_time") >= F.col("event_time")) & (F.col("b_event_time") <= F.col("event_time") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"b_{k}"))
    return a.join(b, cond if extra is None else cond & extra, "inner")


def enrich_from_windows(stream: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, span: tuple[str, str], width: float) -> DataFrame:
    """Stream-static range join: samples to the task windows that hold them."""
    from gatherline.operators.intervals import within_join

    return within_join(stream, ranges, keys, t, span, width)


def _runs_of(keys: list[str], idle: float):
    """The function of a bucket of keys. Rows wait until the watermark has passed them, and are then taken in time order. The
    state holds for each key the open run and the waiting rows, in one value; the timeout is the first waiting row, or the
    end of an open run and ``idle`` after it, of any key."""

    def go_on(_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        held = pickle.loads(state.get[0]) if state.exists else {}
        for r in () if state.hasTimedOut else rows:
            times, flags = r["row_time"].tolist(), r["row_flag"].fillna(False).astype(bool).tolist()
            for key, *new in zip(zip(*(r[k].tolist() for k in keys)), times, flags):
                held.setdefault(key, ((0.0, 0.0, 0), []))[1].append(tuple(new))
        done, left, ends = [], {}, []
        for key, ((start, last, n), waiting) in held.items():
            waiting.sort()
            ready = 0
            for t, on in waiting:
                if _ms(t) >= passed:
                    break
                ready += 1
                if n and (not on or t - last > idle):
                    done.append((*key, start, last, n))
                    n = 0
                if on:
                    start, last, n = (start if n else t), t, n + 1
            if n and _ms(last + idle) < passed:  # silent for long enough: nothing can join the run any more
                done.append((*key, start, last, n))
                n = 0
            if n or ready < len(waiting):
                left[key] = ((start, last, n), waiting[ready:])
                ends += ([_ms(waiting[ready][0])] if ready < len(waiting) else []) + ([_ms(last + idle)] if n else [])
        if left:
            state.update((pickle.dumps(left),))
            state.setTimeoutTimestamp(max(passed, min(ends), 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=[*keys, "run_start", "run_end", "n_rows"])

    return go_on


def _ms(seconds: float) -> int:
    return int(seconds * 1000 // 1)


#: Buckets that the keys of a run operator are dealt into; a call of a worker and one state value serve a bucket.
RUN_BUCKETS = 256


def flag_runs(stream: DataFrame, keys: Sequence[str], t: str, flag: Column, late: str, idle: float) -> DataFrame:
    """Runs of a flag per key: flagged rows in a row, at most ``idle`` seconds apart.

    A run is emitted once the watermark has passed the row without the flag that ends it, or ``idle`` seconds after
    its last row: then a timeout closes it, also for a key that has fallen silent. Rows are taken in time order,
    so the split into micro-batches does not matter. State per key is the open run and the rows of the allowed
    lateness, and is dropped when both are gone. Keys, of any type that survives a cast to string, are served
    by buckets, not one by one. Run with ``run_available(..., rocks=True)``.
    """
    keys = list(keys)
    types = {k: stream.schema[k].dataType for k in keys}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(RUN_BUCKETS)).alias("_bucket")
    # as strings keys stay exact in pandas, nulls among them too
    s = stream.withWatermark("event_time", late).select(bucket, *[F.col(k).cast("string").alias(k) for k in keys], F.col(t).cast("double").alias("row_time"), flag.alias("row_flag"), "event_time")
    fields = ", ".join(f"`{k}` string" for k in keys)
    runs = s.groupBy("_bucket").applyInPandasWithState(_runs_of(keys, idle), f"{fields}, run_start double, run_end double, n_rows long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], "run_start", "run_end", "n_rows")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, folder: str | None = None, rocks: bool = False) -> DataFrame:
    """Process everything there is, write it as parquet, and read that table. ``rocks`` keeps the state in RocksDB,
    beyond the memory of the workers."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    before = spark.conf.get(_PROVIDER)
    if rocks:
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
