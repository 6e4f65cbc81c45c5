"""Left-out-group models against plain fits."""

import numpy as np
import pytest

from gatherline.operators import learn


def _rows(seed, n=90, groups=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 4.0] + [2.0, -1.0]
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n) > 2.6).astype(float)
    x[rng.random((n, 2)) < 0.1] = np.nan
    return np.arange(n) % groups, x, y


def _frame(spark, g, x, y):
    cell = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(i, f"g{g[i]}", cell(x[i, 0]), cell(x[i, 1]), cell(y[i])) for i in range(len(y))], "id int, g string, a double, b double, y double")


def _plain_logistic(x, y, test):
    """Newton with balanced classes and an L2 penalty of one half of the squared weights."""
    mu = np.nanmean(x, 0)
    filled = np.where(np.isnan(x), mu, x)
    sd = filled.std(0)
    z = np.c_[np.ones(len(x)), (filled - mu) / sd]
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.zeros(3)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    t = np.c_[np.ones(len(test)), (np.where(np.isnan(test), mu, test) - mu) / sd]
    return 1 / (1 + np.exp(-t @ b))


def test_logistic_of_all_folds(spark):
    g, x, y = _rows(1)
    y[5] = np.nan  # no outcome
    y[(g == 4)] = 1.0
    got = {r.id: r for r in learn.logo_logistic(_frame(spark, g, x, y).repartition(3), "g", ["a", "b"], "y", binarise=False).collect()}
    known = ~np.isnan(y)
    assert set(got) == set(np.flatnonzero(known).tolist())
    for f in range(5):
        tr, te = known & (g != f), known & (g == f)
        want = _plain_logistic(x[tr], y[tr], x[te])
        rows = [got[i] for i in np.flatnonzero(te)]
        assert [r.model_score for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
        assert [r.model_prediction for r in rows] == (want > 0.5).astype(int).tolist()
        assert {r.baseline_prediction for r in rows} == {int(y[tr].mean() > 0.5)}


def test_logistic_keeps_one_class_folds_and_scores(spark):
    g, x, y = _rows(2, 40, 2)
    y[:] = 0.0
    y[(g == 1) & (np.arange(40) % 3 == 0)] = 1.0  # the other group's model never sees a one
    pred = learn.logo_logistic(_frame(spark, g, x, y), "g", ["a", "b"], "y", binarise=False)
    rows = pred.collect()
    assert len(rows) == 40 and {r.model_score is None for r in rows if r.g == "g1"} == {True} and {r.model_prediction for r in rows if r.g == "g1"} == {0}
    s = {r.metric: r for r in learn.classifier_scores(pred).collect()}
    acc = np.mean([r.model_prediction == r.label for r in rows])
    assert s["accuracy"].linear_model == pytest.approx(acc) and s["roc_auc"].linear_model is None
    d = spark.createDataFrame([(1, 1, 1, 0.9), (0, 1, 0, 0.4), (1, 1, 0, 0.4), (0, 1, 0, 0.1)], "label int, baseline_prediction int, model_prediction int, model_score double")
    s = {r.metric: r for r in learn.classifier_scores(d).collect()}
    assert s["accuracy"].baseline == 0.5 and s["accuracy"].linear_model == 0.75 and s["roc_auc"].linear_model == pytest.approx(0.875)
    assert s["macro_f1"].baseline == pytest.approx((0 + 2 / 3) / 2) and s["macro_f1"].linear_model == pytest.approx((0.8 + 2 / 3) / 2)
    assert learn.logo_logistic(_frame(spark, g, x, y).filter("false"), "g", ["a", "b"], "y").collect() == []


def test_logistic_splits_at_the_training_median(spark):
    g, x, _ = _rows(3, 60, 3)
    v = np.arange(60.0) * 7 % 31
    rows = learn.logo_logistic(_frame(spark, g, x, v), "g", ["a", "b"], "y").collect()
    for f in range(3):
        cut = np.median(v[g != f])
        assert [r.label for r in rows if r.g == f"g{f}"] == [int(r.y >= cut) for r in rows if r.g == f"g{f}"]


def test_penalty_by_inner_groups_and_permutations(spark):
    g, x, _ = _rows(4, 80, 4)
    x = np.where(np.isnan(x), 0.0, x)
    y = x[:, 0] + np.random.default_rng(9).normal(size=80)
    d = _frame(spark, g, x, y)
    sums, _ = learn.group_sums(d, "g", ["a", "b"], ["y"])
    got = {r.g: r.alpha for r in learn.left_out_fits(sums, "g", 2).collect()}

    def fit(tr, a):
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - mu) / sd
        w = np.linalg.solve(z.T @ z + a * np.eye(2), z.T @ (y[tr] - y[tr].mean()))
        return lambda v: y[tr].mean() + ((v - mu) / sd) @ w

    for f in range(4):
        err = [sum(((fit((g != f) & (g != h), a)(x[g == h]) - y[g == h]) ** 2).sum() for h in range(4) if h != f) for a in learn.ALPHAS]
        assert got[f"g{f}"] == pytest.approx(learn.ALPHAS[int(np.argmin(err))])
    for rows in (50_000, 30):
        p = learn.permutation_test(d, "g", ["a", "b"], "y", "id", 39, block_rows=rows).first()
        assert p.p_value == pytest.approx(1 / 40) and p.n_perm == 39 and p.r2 > 0.3
    noise = _frame(spark, g, x, np.random.default_rng(1).normal(size=80))
    assert learn.permutation_test(noise, "g", ["a", "b"], "y", "id", 39).first().p_value > 0.05
    assert learn.r2_of_folds(learn.left_out_fits(sums, "g", 2, inner=2)).first().n == 80
