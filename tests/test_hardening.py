"""All-null, constant, tied, empty and odd input; caps that are gone; streams over several micro-batches."""

import math

import pytest
from pyspark.sql import functions as F

from gatherline.operators import clean, joins, learn, stats, windows
from gatherline.sources import scans
from gatherline.streaming import streams


def test_all_null_column(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    r = {x.feature: x for x in learn.feature_screen(d, ["a", "b"]).collect()}
    assert r["b"].coverage == 0 and not r["b"].eligible
    assert {x.feature: x.zero_pct for x in stats.feature_inventory(d, ["a", "b"]).collect()} == {"a": 0.0, "b": None}


def test_tied_order_values(spark):
    d = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 1.5), ("k", 1.0, 9.0), ("k", 2.0, 1.6)], "k string, t double, x double")
    assert windows.reject_jumps(d, ["k"], "t", "x", 2.0).count() == 4


def test_zero_vector(spark):
    d = spark.createDataFrame([("g", "a", [0.0, 0.0]), ("g", "a", [1.0, 0.0]), ("g", "b", [1.0, 0.0])], "g string, m string, v array<double>")
    assert tuple(joins.cross_member_similarity(d, ["g"], "m", "v").first()) == ("g", 1, 1.0)


def test_collinear_and_constant(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 2.0), (3.0, 7.0, 3.0)], "x double, y double, z double")
    r = stats.partial_correlation(d, "x", "y", "z").first().partial_r
    assert r is None or math.isnan(r)
    s = learn.regression_scores(d.withColumn("y", F.lit(1.0)), "y", "x").first()
    assert s.r2 is None


def test_task_without_number(spark):
    d = spark.createDataFrame([("p", t, float(i), 1.0) for i, t in enumerate(["T0", "T1", "rest", ""])], "p string, t string, a double, b double")
    names = dict.fromkeys(("eda", "scr", "rate", "rmssd", "pupil", "pupil_sd", "missing", "valid"), "a")
    assert {r.t: r.fatigue is None for r in clean.composites(d, ["p"], "t", names).collect()}["rest"]


def test_nan_is_null_on_input(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1.5\tNaN\nNaN\t2\n")
    assert [tuple(r) for r in scans.read_delimited(spark, str(tmp_path), "x double, y double").collect()] == [(1.5, None), (None, 2.0)]


def test_paired_contrasts_keep_small_pairs(spark):
    d = spark.createDataFrame([("p1", "A", 1.0), ("p1", "B", 2.0), ("p2", "A", 1.0), ("p2", "B", 4.0)], "p string, t string, v double")
    r = stats.paired_contrasts(d, ["p"], "t", "v", ["A", "B"], 3).first()
    assert r.n == 2 and r.mean_diff == 2.0 and r.t is None and r.p_wilcoxon is None


@pytest.mark.parametrize("block_rows", [20_000, 3])
def test_knn_impute(spark, block_rows):
    ref = [(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 2.0, 4.0), (5.0, 5.0, None), (9.0, 9.0, 9.0)]
    rows = [(0.0, 1.0, None), (0.0, 0.0, None), (None, None, None), (3.0, None, 7.0), (1.0, 1.0, 1.0), (0.0, 1.0, None)]
    names = "a double, b double, c double"
    out = [tuple(r) for r in learn.knn_impute(spark.createDataFrame(rows, names), spark.createDataFrame(ref, names), ["a", "b", "c"], 2, block_rows).collect()]
    third = sorted(o[2] for o in out if o[0] == 0.0 and o[1] == 1.0)
    assert len(out) == 6 and third == [pytest.approx((1.0 + 4.0) / 2)] * 2
    assert (0.0, 0.0, 1.0) in out and (1.0, 1.0, 1.0) in out and (3.0, 3.2, 4.0) in out
    assert learn.knn_impute(spark.createDataFrame([(None, 1.0)], "a double, b double"), spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"]).first().a == 0.0


def _plain_runs(rows, idle, passed):
    """Runs of flagged rows per key that the watermark has closed."""
    out = []
    for k in {r[0] for r in rows}:
        run = []
        for t, f in [*sorted(r[1:] for r in rows if r[0] == k), (float("inf"), False)]:
            if run and (not f or t - run[-1] > idle):
                if min(t, run[-1] + idle) < passed:
                    out.append((k, run[0], run[-1], len(run)))
                run = []
            if f:
                run.append(t)
    return sorted(out)


def test_flag_runs_over_batches_and_silent_keys(spark, tmp_path):
    base = 1_704_067_200.0  # 2024-01-01
    rng = __import__("random").Random(4)
    rows = [(k, base + 60.0 * i + k, rng.random() < 0.7) for i in range(240) for k in (1, 2, 3) if rng.random() < 0.8]
    rows += [(9, base + 30.0 * i, True) for i in range(5)]  # falls silent with its run open
    rows += [(8, base + 13_000 + i, True) for i in range(3)] + [(1, base + 20_000, False), (7, base + 40_000, True)]
    passed = base + 40_000 - 3_600
    want = _plain_runs(rows, 600.0, passed)
    assert (9, base, base + 120.0, 5) in want and not any(r[0] == 7 for r in want)
    d = spark.createDataFrame(rows, "k long, t double, f boolean").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")).cast("timestamp_ntz"))
    for n in (1, 3):
        at = f"{tmp_path}/{n}"
        edges = [base + 40_001.0 * i / n for i in range(n + 1)]
        for lo, hi in zip(edges, edges[1:]):
            d.where((F.col("t") >= lo) & (F.col("t") < hi)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(at)
        s = streams.read_events(spark, at, files_per_trigger=1)
        r = streams.run_available(streams.flag_runs(s, ["k"], "t", F.col("f"), "1 hour", 600.0), f"{tmp_path}/w{n}", rocks=True)
        assert sorted(tuple(x) for x in r.collect()) == want, n


def test_groups_over_the_old_member_cap(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 2)), np.ones((40, 2))])
    rows = [("big", *map(float, r)) for r in x] + [("two", 0.0, 0.0), ("two", 3.0, 4.0), ("one", 1.0, 1.0), (None, 0.0, 0.0), (None, 0.0, 2.0), ("gap", None, 1.0)]
    d = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: (r.n_members, r.mean_distance) for r in stats.team_diversity(d, ["k"], ["a", "b"], rows_per_tile=100).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum() / (640 * 639)
    assert got["big"] == (640, pytest.approx(far))
    assert got["two"] == (2, 5.0) and got[None] == (2, 2.0) and got["one"] == (1, None) and got["gap"] == (1, None)


def test_matching_of_many_labels(spark):
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(4)
    for shape in ((4, 6), (6, 4), (5, 5), (1, 3)):
        m = rng.integers(0, 50, shape).astype(float)
        t = m if shape[0] <= shape[1] else m.T
        best = max(sum(t[i, j] for i, j in enumerate(p)) for p in permutations(range(t.shape[1]), t.shape[0]))
        assert stats._best_matching(m) == best
    d = spark.range(400).selectExpr("id % 20 AS x", "CASE WHEN id < 40 THEN 0 ELSE (id * 7) % 20 END AS y")
    assert stats.matched_agreement(d, "x", "y").first()["n"] == 400
    assert stats.matched_agreement(d.where("id >= 40"), "x", "y").first()["agreement"] == 1.0
    assert stats.matched_agreement(d.where("id < 0"), "x", "y").count() == 0
    n = spark.createDataFrame([(None, 1), (None, 1), (2, None)], "x int, y int")
    assert stats.matched_agreement(n, "x", "y").first()["agreement"] == 1.0
