"""Exact rank tests against enumeration and hand-made tables."""

from itertools import combinations, product

import numpy as np
import pytest

from gatherline.operators import stats


def test_exact_distributions():
    for n in range(1, 11):
        sums = np.array([sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)])
        assert stats._signed_rank_share(n) == pytest.approx([(sums <= w).mean() for w in range(n * (n + 1) // 2 + 1)])
    for m, n in ((1, 4), (2, 5), (3, 3), (4, 6), (5, 5)):
        u = np.array([sum(c) - m * (m - 1) // 2 for c in combinations(range(n + m), m)])
        assert stats._rank_sum_share(m, n) == pytest.approx([(u <= k).mean() for k in range(m * n // 2 + 1)])
    # fixed values: printed tables of critical sums (two-sided 5 %): n = 10 has 8, groups of 5 and 8 have 6
    assert 2 * stats._signed_rank_share(10)[8] < 0.05 < 2 * stats._signed_rank_share(10)[9]
    assert 2 * stats._rank_sum_share(5, 8)[6] < 0.05 < 2 * stats._rank_sum_share(5, 8)[7]


def test_mann_whitney_rules(spark):
    rows = [("exact", "a", float(v)) for v in (1, 2, 3, 5, 9)] + [("exact", "b", float(v)) for v in (4, 6, 7, 8, 10, 11)]
    rows += [("tied", "a", float(v)) for v in (1, 2, 3, 5, 9)] + [("tied", "b", float(v)) for v in (4, 6, 7, 8, 9, 11)]
    rows += [("few", "a", 1.0), ("few", "b", 2.0)] + [("flat", g, 1.0) for g in "aaaaabbbbb"]
    got = {r.k: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v", "a", "b").collect()}
    assert set(got) == {"exact", "tied", "flat"} and got["flat"].p == 1.0
    u = sum(x > y for x in (1, 2, 3, 5, 9) for y in (4, 6, 7, 8, 10, 11))
    assert got["exact"].u == u and got["exact"].p == pytest.approx(2 * stats._rank_sum_share(5, 6)[u])
    sd = np.sqrt(30 / 12 * (12 - (2**3 - 2) / (11 * 10)))
    from math import erfc

    assert got["tied"].p == pytest.approx(erfc((abs(got["tied"].u - 15) - 0.5) / sd / 2**0.5), abs=1e-6)


def test_paired_contrasts_exact_and_q(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 3)) + [0.0, 0.6, 0.1]
    rows = [(i, t, float(v[i, j])) for i in range(9) for j, t in enumerate(("T1", "T2", "T3"))]
    got = stats.paired_contrasts(spark.createDataFrame(rows, "p int, t string, v double"), ["p"], "t", "v", ["T1", "T2", "T3"]).collect()
    for r in got:
        d = v[:, int(r.task_b[1]) - 1] - v[:, int(r.task_a[1]) - 1]
        w = sum(k + 1 for k, i in enumerate(np.argsort(abs(d))) if d[i] > 0)
        assert r.w == min(w, 45 - w) and r.p_wilcoxon == pytest.approx(min(1, 2 * stats._signed_rank_share(9)[int(r.w)]))
    p = sorted(r.p_wilcoxon for r in got)
    q = sorted(r.q_wilcoxon for r in got)
    assert q == pytest.approx([min(p[j] * 3 / (j + 1) for j in range(i, 3)) for i in range(3)])
