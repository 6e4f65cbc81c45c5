"""The ordered primitives against plain Python, with keys cut into many blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.operators import ordered as o


def _rows(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        v = None if rnd.random() < 0.3 else float(rnd.randint(0, 20))
        rows.append((i, key, rnd.random() * 100, v))
    rows.append((9999, "single", 1.0, 2.0))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [40, 10_000])
def test_scan_matches_brute_force(spark, block):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "id long, k string, t double, v double").repartition(7)
    out = o.ordered_scan(
        df, ["k"], ["t", "id"],
        {
            "p": o.prev("v"), "n": o.next_("v"), "lv": o.last_valid("v"), "lb": o.last_valid_before("v"),
            "nv": o.next_valid("v"), "cs": o.cum_sum("v"), "cm": o.cum_max("v"),
            "cb": o.cum_max_before("v"), "rm": o.rev_min("v"), "rn": o.row_no(), "ks": o.key_sum("v"),
        },
        rows_per_block=block,
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[1] for r in rows}:
        seq = sorted([r for r in rows if r[1] == k], key=lambda r: (r[2], r[0]))
        vs = [r[3] for r in seq]
        for i, r in enumerate(seq):
            g = got[r[0]]
            past = [x for x in vs[: i + 1] if x is not None]
            strict = [x for x in vs[:i] if x is not None]
            ahead = [x for x in vs[i:] if x is not None]
            assert g["p"] == (vs[i - 1] if i else None)
            assert g["n"] == (vs[i + 1] if i + 1 < len(vs) else None)
            assert g["lv"] == (past[-1] if past else None)
            assert g["lb"] == (strict[-1] if strict else None)
            assert g["nv"] == (ahead[0] if ahead else None)
            assert g["cs"] == (sum(past) if past else None)
            assert g["cm"] == (max(past) if past else None)
            assert g["cb"] == (max(strict) if strict else None)
            assert g["rm"] == (min(ahead) if ahead else None)
            assert g["rn"] == i + 1
            assert g["ks"] == sum(x for x in vs if x is not None)


def test_cuts_follow_the_rows(spark):
    """A burst at one instant, outliers and null times do not fill a block."""
    rows = [(i, "hot", 5.0) for i in range(4_000)] + [(5_000 + i, "hot", 10.0 ** (2 * i)) for i in range(10)] + [(6_000 + i, "hot", i / 500) for i in range(2_000)]
    rows += [(8_000 + i, "hot", None) for i in range(500)] + [(9_000, "cold", 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, t double").repartition(6)
    cuts = o.cuts_of(df, ["k"], ["t", "id"], 200)
    blocks = o.with_blocks(df, ["k"], ["t", "id"], cuts)
    got = {r["_blk"]: r["n"] for r in blocks.groupBy("_blk").agg(F.count("*").alias("n")).collect()}
    assert got[-1] == 1 and len(got) > 20 and max(n for b, n in got.items() if b >= 0) < 800
    place = sorted((r["_blk"], r["t"] is not None, r["t"] or 0, r["id"]) for r in blocks.filter("k = 'hot'").collect())
    assert [p[1:] for p in place] == sorted(p[1:] for p in place)
    assert o.cuts_of(df, ["k"], ["t", "id"], 10**9) is None


@pytest.mark.parametrize("error", [0.02, 1e-4])
def test_percentiles_and_ranks(spark, error, monkeypatch):
    monkeypatch.setattr(o, "RANK_ERROR", error)
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else "b", rnd.choice([-1, 1]) * rnd.expovariate(0.01)) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("w", F.lit(None).cast("double")).repartition(5)
    q = o.exact_percentiles(df, ["k"], {"m": ("v", 0.5), "p95": ("v", 0.95), "lo": ("v", 0.0), "hi": ("v", 1.0), "of_none": ("w", 0.5)})
    for r in q.collect():
        assert r["of_none"] is None
        vals = [v for k, v in rows if k == r["k"]]
        assert r["m"] == pytest.approx(np.median(vals))
        assert r["p95"] == pytest.approx(np.percentile(vals, 95))
        assert (r["lo"], r["hi"]) == (min(vals), max(vals))
    assert o.exact_percentiles(df, [], {"m": ("v", 0.5)}).collect()[0]["m"] == pytest.approx(np.median([v for _, v in rows]))
    tied = df.withColumn("v", F.round("v", -2))
    ranks = o.value_ranks(tied, ["k"], "v", rows_per_block=3).collect()
    for r in ranks:
        vals = [x for x in [round(v, -2) for k, v in rows if k == r["k"]]]
        lower = sum(x < r["v"] for x in vals)
        same = sum(x == r["v"] for x in vals)
        assert r["min_rank"] == lower + 1 and r["avg_rank"] == lower + (same + 1) / 2


def test_top_row(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, None, "z")], "k int, v int, s string")
    got = {r["k"]: r["s"] for r in o.top_row(df, ["k"], F.struct("v", "s")).collect()}
    assert got == {1: "y", 2: "z"}
