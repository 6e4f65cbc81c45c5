"""Sweeps over overlapping intervals against plain versions, with crowded keys."""

import random

import pytest

from gatherline.operators import intervals, joins


def _segments(seed, n, spread, most):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = float(rnd.randint(0, spread))
        rows.append((rnd.choice("kl"), i, rnd.choice(["A", "B", "C", None]), a, a + rnd.choice([0.0, 1.0, 5.0, float(most)])))
    return rows


@pytest.mark.parametrize("n,spread,most", [(60, 200, 12), (250, 40, 400)])
def test_covered_seconds(spark, n, spread, most):
    rows = _segments(n, n, spread, most)
    d = spark.createDataFrame(rows, "k string, id int, who string, a double, z double").repartition(4)
    got = {(r.k, r.id): r.covered_s for r in intervals.covered_seconds(d, d.filter("id % 3 <> 0"), ["k"], "id", ("a", "z"), "who").collect()}
    want = {}
    for k, i, w, a, z in rows:
        hit = sorted((max(a, s), min(z, e)) for g, j, v, s, e in rows if g == k and j % 3 and w and v and v != w and s < e and max(a, s) < min(z, e))
        total, end = 0.0, float("-inf")
        for s, e in hit:
            total += max(0.0, e - max(s, end))
            end = max(end, e)
        if total > 0:
            want[k, i] = total
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n,spread,most", [(40, 300, 12), (200, 60, 500)])
def test_surrounding_segments(spark, n, spread, most):
    segs = [r for r in _segments(n, n, spread, most)]
    evs = _segments(n + 1, 60, spread, 30)
    s = spark.createDataFrame(segs, "k string, sid int, who string, a double, z double").repartition(3)
    e = spark.createDataFrame(evs, "k string, id int, who string, a double, z double")
    got = {r.id: (r.seg_a and r.seg_a.sid, r.seg_b and r.seg_b.sid) for r in joins.surrounding_segments(e, s, ["k"], "id", "a", "z", ["sid"]).collect()}
    for k, i, _, a, z in evs:
        own = sorted((s_, j, e_) for g, j, _, s_, e_ in segs if g == k)
        over = [j for s_, j, e_ in own if s_ < z and a < e_]
        early = [j for s_, j, _ in own if s_ < a]
        if len(over) > 1:
            want = (over[0], over[1])
        elif over:
            want = (early[-1], over[0]) if early else (over[0], None)
        else:
            want = (early[-2], early[-1]) if len(early) > 1 else (None, None)
        assert got[i] == want, (i, over[:3], early[-3:])
