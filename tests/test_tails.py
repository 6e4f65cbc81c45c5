"""p values against plain numeric integration; q values with nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.operators import stats


def _t_plain(t, nu):
    x = (np.arange(200_000) + 0.5) / 200_000 * math.atan(abs(t) / math.sqrt(nu))
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return 1 - 2 * c * float((np.cos(x) ** (nu - 1)).mean()) * math.atan(abs(t) / math.sqrt(nu))


def _chi2_plain(x, k):
    u = (np.arange(400_000) + 0.5) / 400_000 * math.sqrt(x)  # chi, so that one degree has no pole
    logs = (k - 1) * np.log(u) - u * u / 2 - (k / 2 - 1) * math.log(2) - math.lgamma(k / 2)
    return 1 - float(np.exp(logs).mean()) * math.sqrt(x)


def test_t_tail(spark):
    cases = [(t, nu) for t in (0.0, 0.3, -2.0, 3.5) for nu in (1, 2, 3, 4, 9, 28, 500, 1000, 1001, 20_000)]
    got = spark.createDataFrame(cases, "t double, nu long").select("t", "nu", stats.t_tail(F.col("t"), F.col("nu")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(_t_plain(r.t, r.nu), abs=2e-6), r


def test_chi2_tail(spark):
    cases = [(x, k) for x in (0.5, 3.0, 12.0, 60.0) for k in (1, 2, 3, 4, 7, 40)] + [(1010.0, 1000), (1050.0, 1001), (1500.0, 999)]
    got = spark.createDataFrame(cases, "x double, k long").select("x", "k", stats.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(_chi2_plain(r.x, r.k), abs=2e-5 if r.k > 900 else 1e-6), r


def test_tails_without_a_test(spark):
    d = spark.createDataFrame([(None, 3), (2.0, 0), (2.0, None)], "x double, k long")
    assert [tuple(r) for r in d.select(stats.t_tail(F.col("x"), F.col("k")), stats.chi2_tail(F.col("x"), F.col("k"))).collect()] == [(None, None)] * 3


def test_p_and_q_of_a_table(spark):
    rows = [("a", 30, 0.5), ("b", 30, None), ("c", 30, 1.0), ("d", 2, 0.9), ("e", 30, 0.1)]
    got = {r.f: r for r in stats.with_p_and_q(spark.createDataFrame(rows, "f string, n long, r double"), "r", ["f"]).collect()}
    assert got["b"].p is None and got["b"].q is None and got["d"].p is None
    assert got["c"].p == 0.0 and got["c"].q == 0.0
    assert got["a"].p == pytest.approx(_t_plain(0.5 * math.sqrt(28 / 0.75), 28), abs=1e-9)
    assert got["a"].q == pytest.approx(got["a"].p * 3 / 2) and got["e"].q == pytest.approx(got["e"].p)


def test_kruskal_small_groups(spark):
    rows = [("x", float(i)) for i in range(6)] + [("y", i + 2.5) for i in range(6)] + [("z", 100.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    r = stats.kruskal(d, [], "g", "v", min_n=2).first()
    assert (r.k, r.n) == (2, 12) and 0 < r.p < 1
    assert r.p == pytest.approx(_chi2_plain(r.h, 1), abs=1e-6)
    one = stats.kruskal(d, [], "g", "v", min_n=7).collect()
    assert not one or one[0].p is None
