"""Hidden Markov models: against enumeration and a plain EM, whole and in blocks, one job a fit and one a pass."""

import itertools

import numpy as np
import pytest

from gatherline.operators import hmm


def _rows(seed, n=9, most=7):
    rng = np.random.default_rng(seed)
    return [(k, t, float(v)) for k in range(n) for t, v in enumerate(rng.normal(k % 3, 1, 2 + k % most))]


def _model():
    return hmm.Model(3, means=np.array([[0.0], [1.0], [2.0]]), vars=np.full((3, 1), 0.8), start=np.array([0.5, 0.2, 0.3]), trans=np.array([[0.5, 0.3, 0.2], [0.45, 0.1, 0.45], [0.2, 0.3, 0.5]]))


def _paths(m, x):
    e = -0.5 * np.log(2 * np.pi * m.vars[:, 0]) - 0.5 * (x[:, None] - m.means[:, 0]) ** 2 / m.vars[:, 0]
    return {p: np.log(m.start[p[0]]) + sum(np.log(m.trans[a, b]) for a, b in itertools.pairwise(p)) + sum(e[t, s] for t, s in enumerate(p)) for p in itertools.product(range(m.k), repeat=len(x))}


@pytest.mark.parametrize("block", [3, 1000])
def test_paths_posteriors_and_counts(spark, block):
    m, rows = _model(), _rows(3)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(99, 0, None, "x")], "k int, t int, x double, `a.b` string").drop("a.b")
    table = hmm.settle(hmm.packed(df, ["k"], ["t"], ["x"], ["t"], block_rows=block))
    got = {(r.k, r.t): r for r in hmm.decoded(table, ["k"], [m], 1, ["t"]).collect()}
    assert len(got) == len(rows)
    n, sx, ll, differs = np.zeros(3), np.zeros(3), 0.0, 0
    for k in {r[0] for r in rows}:
        x = np.array([v for i, _, v in rows if i == k])
        score = _paths(m, x)
        best = max(score, key=score.get)
        w = np.exp(np.array(list(score.values())))
        on = np.array([[sum(w[[p[t] == s for p in score]]) for s in range(3)] for t in range(len(x))]) / w.sum()
        assert [got[k, t].state for t in range(len(x))] == list(best)
        assert [got[k, t].probability for t in range(len(x))] == pytest.approx([on[t, s] for t, s in enumerate(best)])
        n, sx, ll = n + on.sum(0), sx + on.T @ (x - m.means.mean()), ll + np.log(w.sum())
        differs += list(best) != on.argmax(1).tolist()
    assert differs  # decoding by posteriors would give other states
    v = hmm._pass(table, ["k"], [m], 1, block == 3)[0]
    assert v[:3] == pytest.approx(n) and v[3:6] == pytest.approx(sx) and v[-1] == pytest.approx(ll)
    assert v[9:18].sum() == pytest.approx(len(rows) - 9)  # one transition less than rows in each sequence


def _plain_em(x, k, rounds):
    """Baum-Welch on one long sequence, by the book."""
    mu, var = np.array([-1.0, 7.0]), np.array([4.0, 4.0])
    st, a, out = np.full(k, 0.5), np.full((k, k), 0.5), []
    for _ in range(rounds):
        e = np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var)
        al, c = np.zeros_like(e), np.zeros(len(x))
        for t in range(len(x)):
            al[t] = (st if t == 0 else al[t - 1] @ a) * e[t]
            c[t] = al[t].sum()
            al[t] /= c[t]
        be = np.ones_like(e)
        for t in range(len(x) - 2, -1, -1):
            be[t] = a @ (e[t + 1] * be[t + 1]) / c[t + 1]
        g = al * be
        xi = sum(al[t][:, None] * a * (e[t + 1] * be[t + 1]) / c[t + 1] for t in range(len(x) - 1))
        out.append(np.log(c).sum())
        st, a = g[0], xi / xi.sum(1, keepdims=True)
        mu = (g * x[:, None]).sum(0) / g.sum(0)
        var = (g * (x[:, None] - mu) ** 2).sum(0) / g.sum(0)
    return out[-1], mu


def test_fit_reaches_the_maximum(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(4, 1, 60), rng.normal(0, 1, 40)])
    df = spark.createDataFrame([("s", i, float(v), i % 2) for i, v in enumerate(x)], "k string, t int, x double, id int")
    best, mu = _plain_em(x, 2, 300)
    fits = []
    for block, parts in ((25, 1), (1000, 1), (1000, 3)):
        table = hmm.settle(hmm.packed(df, ["k"], ["t"], ["x"], block_rows=block).repartition(parts))
        fits += hmm.fit_packed(table if parts == 1 else table.repartition(parts), ["k"], [hmm.Model(2)], 1)
    for m in fits:
        assert m.converged and m.rounds <= 200
        assert all(b >= a - 1e-9 for a, b in itertools.pairwise(m.history))
        assert m.loglik == pytest.approx(best, abs=1e-3) and m.means[:, 0] == pytest.approx(np.sort(mu), abs=1e-2)
        assert m.occupancy.sum() == pytest.approx(len(x)) and m.n_rows == len(x)
    assert fits[0].rounds < 40  # plain EM needs more


def test_choice_and_stability(spark):
    rng = np.random.default_rng(5)
    rows = [(g, t, float(rng.normal(6 * ((t // 6) % 2), 1)), 1000 * g + t) for g in range(10) for t in range(40)]
    rows += [(10, t, 0.0, 10_000 + t) for t in range(3)]  # too short to count
    df = spark.createDataFrame(rows, "g int, t int, x double, id int")
    best = hmm.choose(df, ["g"], ["t"], ["x"], ks=(2, 3), seeds=(1, 2))
    assert [m.k for m in best] == [2, 3] and best[0].n_rows == 403
    got = {r.fold: r for r in hmm.state_stability(df.filter("g < 10"), ["g"], ["t"], ["x"], 2, "g", "id").collect()}
    assert set(got) == set(range(5)) and all(r.n_shared == 8 * 40 and r.ari > 0.9 and r.agreement > 0.97 for r in got.values())
    assert sum(r.n_shared for r in hmm.state_stability(df, ["g"], ["t"], ["x"], 2, "g", "id", folds=11).collect()) == 400 * 11 - 400
