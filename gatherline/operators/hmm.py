"""Gaussian hidden Markov models fitted by EM over many sequences, several models in one pass.

Sequences are packed once: a row holds up to BLOCK_ROWS consecutive rows of a sequence as
one array, in a table of the shared folder, so a pass neither shuffles nor sorts. One pass
(a Spark job) gives the expected counts of every model that is still being fitted; a task
runs all its sequences side by side, one time step after the other. A sequence longer than
a block gets what enters and leaves each of its blocks from K x K transfer matrices first, so it
is spread over as many tasks as it has blocks. Squared extrapolation spares most of the rounds
that plain EM would need.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherline.operators.ordered import join_on, ordered_scan, row_no, settle

BLOCK_ROWS = 100_000
#: Rows that the K-means start looks at; EM goes over all rows.
START_ROWS = 4_096
VAR_FLOOR, LEAST = 1e-4, 1e-10
_CELLS = 1 << 20
#: Rows up to which each model is fitted in a task of its own, which saves a job a pass; beyond, a pass is spread over all cores.
ROWS_IN_A_TASK = 700_000


@dataclass
class Model:
    """States ordered by the mean of the first feature once fitted; ``history`` is the log likelihood of each round
    kept, ``occupancy`` the expected rows of each state in the last one."""

    k: int
    seed: int = 0
    leave_out: int | None = None
    means: np.ndarray | None = None
    vars: np.ndarray | None = None
    start: np.ndarray | None = None
    trans: np.ndarray | None = None
    loglik: float = float("nan")
    rounds: int = 0
    n_rows: int = 0
    converged: bool = False
    occupancy: np.ndarray | None = None
    history: list[float] = field(default_factory=list)

    @property
    def bic(self) -> float:
        d = self.means.shape[1]
        return -2 * self.loglik + (self.k * (2 * d + self.k - 1) + self.k - 1) * np.log(max(self.n_rows, 1))

    def params(self) -> tuple[np.ndarray, ...]:
        return self.means, self.vars, self.start, self.trans

    def set(self, params: Sequence[np.ndarray]) -> None:
        self.means, self.vars, self.start, self.trans = params


# ------------------------------------------------------------------ packed sequences


def packed(df: DataFrame, keys: Sequence[str], order: Sequence, features: Sequence[str], keep: Sequence[str] = (), fold=None, block_rows: int | None = None) -> DataFrame:
    """(keys, block, blocks, n, fold, x, keep): the rows of each block of a sequence in order, x row after row.

    Rows with a null feature are left out.
    """
    block_rows = block_rows or BLOCK_ROWS
    x = F.array(*[F.col(c).cast("double") for c in features])
    d = df.dropna(subset=list(features)).withColumn("_x", x).withColumn("_keep", F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("_")))
    d = d.withColumn("_fold", (fold if fold is not None else F.lit(-1)).cast("int"))
    d = ordered_scan(d, keys, order, {"_pos": row_no()})
    d = d.withColumn("block", F.floor((F.col("_pos") - 1) / block_rows).cast("int"))
    rows = d.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x", "_keep"))).alias("_r"), F.first("_fold").alias("fold"))
    return rows.select(
        *keys, "block", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int").alias("blocks"), F.size("_r").alias("n"), "fold",
        F.flatten(F.col("_r._x")).alias("x"), F.col("_r._keep").alias("keep"),
    )


def _spread(packed_rows: DataFrame) -> DataFrame:
    """The packed table in the shared folder; a large one in a few files a core, since packed sequences are small to read
    and long to work on: by size alone a handful of tasks would get them all."""
    table = settle(packed_rows)
    if (table.agg(F.sum("n")).first()[0] or 0) <= ROWS_IN_A_TASK:
        return settle(table.coalesce(1)) if table.rdd.getNumPartitions() > 1 else table
    return settle(table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism))


def _grid(column, n: np.ndarray, dims: int) -> np.ndarray:
    """Sequences side by side: (time, sequence, feature), shorter ones padded at the end."""
    flat = np.asarray(column.flatten(), float).reshape(-1, dims)
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros((int(n.max()), len(n), dims))
    for i, m in enumerate(n.tolist()):
        out[:m, i] = flat[at[i] : at[i + 1]]
    return out


def _portions(batch, dims: int, wide: int = 1):
    """Slices of a batch with longest sequences first and a bounded padded size."""
    n = np.asarray(batch.column("n"))
    by = np.argsort(-n, kind="stable")
    lo = 0
    while lo < len(by):
        hi = lo + max(1, _CELLS // max(1, int(n[by[lo]]) * max(dims, 4 * wide)))
        part = batch.take(pa.array(by[lo:hi]))
        yield part, n[by[lo:hi]]
        lo = hi


class Stack:
    """Models with the same number of states, side by side: (model, state, ...)."""

    def __init__(self, models: list[Model]):
        self.k, self.size = models[0].k, len(models)
        self.means, self.vars, self.start, self.trans = (np.array([getattr(m, c) for m in models]) for c in ("means", "vars", "start", "trans"))
        self.middle = self.means.mean(1)

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Densities (time, model, state, sequence) relative to the likeliest state, and that state's log density.

        Sequences come last, here and below, so that numpy's inner loops run over many of them and not over a few states."""
        log = np.empty((len(x), self.size, self.k, x.shape[1]))
        log[:] = (-0.5 * np.log(2 * np.pi * self.vars).sum(2))[:, :, None]
        for d in range(x.shape[2]):
            off = x[:, None, None, :, d] - self.means[:, :, None, d]
            off *= off
            off *= (0.5 / self.vars[:, :, d])[:, :, None]
            log -= off
        top = log.max(2)
        log -= top[:, :, None]
        return np.exp(log, out=log), top


def _live(n: np.ndarray) -> list[int]:
    """How many of the sequences, longest first, are at least t + 1 long."""
    return np.searchsorted(-n, -np.arange(int(n.max())), side="left").tolist()


def _forward(e, live, first, trans):
    """Filtered state probabilities, and each row's normaliser."""
    a, c = np.zeros_like(e), np.ones((e.shape[0], e.shape[1], e.shape[3]))
    on = trans.transpose(0, 2, 1)
    for t, m in enumerate(live):
        now = (on @ a[t - 1, :, :, :m] if t else first) * e[t, :, :, :m]
        s = np.maximum(now.sum(1), 1e-300)
        np.divide(now, s[:, None], out=a[t, :, :, :m])
        c[t, :, :m] = s
    return a, c


def _backward(e, live, last, trans):
    b = np.zeros_like(e)
    for t in range(len(live) - 1, -1, -1):
        m, on = live[t], live[t + 1] if t + 1 < len(live) else 0
        b[t, :, :, on:m] = last[:, :, on:m]
        if on:
            now = trans @ (e[t + 1, :, :, :on] * b[t + 1, :, :, :on])
            np.divide(now, np.maximum(now.sum(1), 1e-300)[:, None], out=b[t, :, :, :on])
    return b


def _entering(part, model: Stack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the state before each block (none for first ones), of its first row, and what follows it."""
    shape = (model.size, model.k, part.num_rows)
    before, last = np.zeros(shape), np.ones(shape)
    first = np.broadcast_to(model.start[:, :, None], shape).copy()
    if "alpha" in part.schema.names:  # for one model only
        for i, (al, be) in enumerate(zip(part.column("alpha").to_pylist(), part.column("beta").to_pylist(), strict=True)):
            last[:, :, i] = be
            if al:
                before[:, :, i], first[:, :, i] = al, np.asarray(al) @ model.trans[0]
    return before, first, last


def _posterior(part, n, x, model: Stack):
    before, first, last = _entering(part, model)
    e, top = model.emissions(x)
    live = _live(n)
    a, c = _forward(e, live, first, model.trans)
    b = _backward(e, live, last, model.trans)
    g = a * b
    s = g.sum(2)
    return before, e, top, live, a, b, c, s, np.divide(g, s[:, :, None], out=np.zeros_like(g), where=s[:, :, None] > 0)


def _counts(part, n, x, model: Stack) -> np.ndarray:
    """Expected counts over some sequences, one row of numbers for each model."""
    before, e, top, live, a, b, c, s, g = _posterior(part, n, x, model)
    there = np.arange(len(live))[:, None] < n
    w = (c * s)[:, :, None]  # the weight of all steps into a row; none where a sequence has ended
    b *= e
    q = np.divide(b, w, out=np.zeros_like(b), where=w > 0)
    xi = before @ q[0].transpose(0, 2, 1) + (a[:-1] @ q[1:].transpose(0, 1, 3, 2)).sum(0)
    inside = before[0].any(0)
    xf = x[:, None] - model.middle[:, None]  # moved, so that squares stay small
    moments = (g @ np.concatenate((xf, xf * xf), 3)).sum(0)
    dims = x.shape[2]
    ll = (np.log(c) + np.where(there[:, None], top, 0.0)).sum((0, 2))
    flat = [g.sum((0, 3)), moments[:, :, :dims], moments[:, :, dims:], model.trans * xi, g[0][:, :, ~inside].sum(2), ll]
    return np.concatenate([v.reshape(model.size, -1) for v in flat], 1)


def _likelihoods(part, n, x, model: Stack) -> np.ndarray:
    """The last number of ``_counts`` alone, from the forward half."""
    e, top = model.emissions(x)
    _, c = _forward(e, _live(n), _entering(part, model)[1], model.trans)
    there = np.arange(len(e))[:, None] < n
    return (np.log(c) + np.where(there[:, None], top, 0.0)).sum((0, 2))[:, None]


# ------------------------------------------------------------------ one pass over all models


def _transfers(table: DataFrame, keys: list[str], models: list[Model], dims: int) -> DataFrame:
    """(keys, block, model, alpha, beta, ll): what enters and leaves each block of the long sequences, for each model."""

    def blocks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = np.asarray(row.column("n"))
                x = _grid(row.column("x"), n, dims)
                for j, m in enumerate(models):
                    if m.leave_out is not None and row.column("fold")[0].as_py() == m.leave_out:
                        continue
                    e, top = Stack([m]).emissions(x)
                    v, log = (np.tile(m.start, (m.k, 1)) if row.column("block")[0].as_py() == 0 else m.trans) * e[0, 0, :, 0], top.sum()
                    for t in range(len(e)):
                        if t:
                            v = (v @ m.trans) * e[t, 0, :, 0]
                        s = max(v.sum(), 1e-300)
                        v, log = v / s, log + np.log(s)
                    cells = [*[row.column(c) for c in keys], row.column("block"), pa.array([j], pa.int32()), pa.array([v.ravel().tolist()], pa.list_(pa.float64())), pa.array([log])]
                    yield pa.RecordBatch.from_arrays(cells, [*keys, "block", "model", "v", "log"])

    def borders(pdf):
        pdf = pdf.sort_values("block")
        k = round(len(pdf["v"].iloc[0]) ** 0.5)
        v = [np.asarray(x).reshape(k, k) for x in pdf["v"]]
        f, ll = [v[0][0] / v[0][0].sum()], float(pdf["log"].sum()) + np.log(v[0][0].sum())
        for x in v[1:]:
            now = f[-1] @ x
            ll += np.log(max(now.sum(), 1e-300))
            f.append(now / max(now.sum(), 1e-300))
        g = [np.ones(k)]
        for x in v[:0:-1]:
            now = x @ g[-1]
            g.append(now / max(now.sum(), 1e-300))
        out = pdf[[*keys, "block", "model"]].copy()
        out["alpha"], out["beta"], out["ll"] = [[]] + [x.tolist() for x in f[:-1]], [x.tolist() for x in g[::-1]], [ll] + [0.0] * (len(v) - 1)
        return out

    ks = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keys)
    m = table.select(*keys, "block", "n", "fold", "x").mapInArrow(blocks, f"{ks}, block int, model int, v array<double>, log double")
    return m.groupBy(*keys, "model").applyInPandas(borders, f"{ks}, block int, model int, alpha array<double>, beta array<double>, ll double")


def _sum_counts(batches, models: list[Model], dims: int, count=_counts) -> dict[int, np.ndarray]:
    """Expected counts of each model over the sequences of some Arrow batches."""
    total: dict[int, np.ndarray] = {}
    alike: dict[tuple, list[int]] = {}
    for j, m in enumerate(models):
        alike.setdefault((m.k, m.leave_out), []).append(j)
    for batch in batches:
        for part, n in _portions(batch, dims, max(map(len, alike.values()))):
            x = _grid(part.column("x"), n, dims)
            fold = np.asarray(part.column("fold"))
            which = np.asarray(part.column("model")) if "model" in part.schema.names else None  # blocks come once for each model
            groups = list(alike.items()) if which is None else [((models[j].k, models[j].leave_out), [j]) for j in np.unique(which).tolist()]
            for (_, leave_out), js in groups:
                use = np.ones(len(n), bool) if which is None else which == js[0]
                if leave_out is not None:
                    use &= fold != leave_out
                if not use.any():
                    continue
                some = np.flatnonzero(use)
                mine = part if use.all() else part.take(pa.array(some))
                got = count(mine, n[some], x[: int(n[some].max()), some], Stack([models[j] for j in js]))
                if which is not None:  # a long sequence's likelihood comes from its borders
                    got[0, -1] = sum(mine.column("ll").to_pylist())
                for j, v in zip(js, got, strict=True):
                    total[j] = total.get(j, 0) + v
    return total


def _pass(table: DataFrame, keys: list[str], models: list[Model], dims: int, long: bool) -> list[np.ndarray]:
    """Expected counts of each model over all sequences with two rows or more."""

    def run(batches):
        for j, v in _sum_counts(batches, models, dims).items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["model", "v"])

    short = table.where("blocks = 1 and n > 1").select("n", "fold", "x").mapInArrow(run, "model int, v array<double>")
    if long:
        many = table.where("blocks > 1").select(*keys, "block", "n", "fold", "x")
        short = short.unionByName(join_on(many, _transfers(many, keys, models, dims), [*keys, "block"], "inner").select("n", "fold", "x", "model", "alpha", "beta", "ll").mapInArrow(run, "model int, v array<double>"))
    width = max(m.k * (2 + 2 * dims + m.k) + 1 for m in models)
    sums = short.groupBy("model").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]).collect()  # one row a model
    got = {r["model"]: np.array([v for v in r[1:] if v is not None]) for r in sums}
    return [got.get(j) for j in range(len(models))]


# ------------------------------------------------------------------ fitting


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10, rounds: int = 50) -> np.ndarray:
    """Labels of the best of several K-means runs with spread-out first centres."""
    best, least = np.zeros(len(x), int), np.inf
    for _ in range(starts):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack((c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]))
        for _ in range(rounds):
            label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.array_equal(new, c):
                break
            c = new
        cost = ((x - c[label]) ** 2).sum()
        if cost < least:
            best, least = label, cost
    return best


def _m_step(v: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    k, d = model.means.shape
    n, sx, sq, xi, st = np.split(v[:-1], np.cumsum([k, k * d, k * d, k * k]))
    some = (n > 1e-6)[:, None]
    safe = np.maximum(n, 1e-300)[:, None]
    off = sx.reshape(k, d) / safe
    means = np.where(some, model.means.mean(0) + off, model.means)
    var = np.where(some, np.maximum(sq.reshape(k, d) / safe - off**2, VAR_FLOOR), model.vars)
    xi = xi.reshape(k, k)
    rows = xi.sum(1, keepdims=True)
    trans = np.maximum(np.where(rows > 0, xi / np.maximum(rows, 1e-300), model.trans), LEAST)
    return means, var, np.maximum(st / st.sum(), LEAST), trans


def _free(p):
    return np.concatenate([p[0].ravel(), np.log(p[1]).ravel(), p[2], p[3].ravel()])


def _bound(z, like):
    k, d = like[0].shape
    means, var, st, tr = np.split(z, np.cumsum([k * d, k * d, k]))
    st, tr = np.maximum(st, LEAST), np.maximum(tr.reshape(k, k), LEAST)
    return means.reshape(k, d), np.clip(np.exp(np.clip(var, -50.0, 50.0)).reshape(k, d), VAR_FLOOR, None), st / st.sum(), tr / tr.sum(1, keepdims=True)


#: Extrapolated steps tried side by side in one pass: plain lengths, and multiples of the one that the differences suggest.
LENGTHS, MULTIPLES = (2.0, 4.0, 8.0), (0.5, 1.0)


class _Climb:
    """EM of one model with squared extrapolation.

    A plain round gives two differences of parameters; the next pass weighs the second plain round against
    several steps along them, and the likeliest goes on. So a step never lowers the likelihood.
    """

    def __init__(self, model: Model, max_iter: int, tol: float):
        self.m, self.max_iter, self.tol = model, max_iter, tol
        self.trials = [model.params()]
        self.origin = None  # parameters before the plain round under way

    def wanted(self) -> list[Model]:
        return [replace(self.m, means=p[0], vars=p[1], start=p[2], trans=p[3]) for p in self.trials]

    @staticmethod
    def likeliest(counts: list[np.ndarray]) -> int:
        return max(range(len(counts)), key=lambda i: counts[i][-1] if np.isfinite(counts[i][-1]) else -np.inf)

    def take(self, counts: list[np.ndarray]) -> bool:
        """The counts at the wanted parameters (of all but the likeliest, the likelihood will do); sets the next ones.
        True when the fit has ended."""
        m = self.m
        m.rounds += 1
        plain, single = 0, len(counts) == 1
        best = plain if single else self.likeliest(counts)
        ll = float(counts[best][-1])
        gain = float(counts[plain][-1]) - m.loglik if m.history else np.inf
        at = self.trials[best]
        m.set(at)
        m.loglik, m.occupancy = ll, counts[best][: m.k]
        m.history.append(ll)
        new = _m_step(counts[best], m)
        m.converged = abs(gain) < self.tol and best == plain
        if m.converged or m.rounds >= self.max_iter:
            m.set(new)
            return True
        if not single or self.origin is None:
            self.origin, self.trials = at, [new]
            return False
        z0, z1, z2 = _free(self.origin), _free(at), _free(new)
        r, w = z1 - z0, z2 - 2 * z1 + z0
        size = np.sqrt((w * w).sum())
        usual = np.sqrt((r * r).sum()) / size if size > 0 else 1.0
        lengths = sorted({*LENGTHS, *[max(2.0, usual * s) for s in MULTIPLES]})
        self.trials = [new, *[_bound(z0 + 2 * s * r + s * s * w, new) for s in lengths]]
        return False


def _logs(p: Sequence[np.ndarray]) -> np.ndarray:
    """Parameters without bounds: means, and logarithms of the others."""
    return np.concatenate([p[0].ravel(), *[np.log(x).ravel() for x in p[1:]]])


def _place(z: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    d = (len(z) - k - k * k) // (2 * k)
    means, var, st, tr = np.split(z, np.cumsum([k * d, k * d, k]))
    share = lambda x: (w := np.maximum(np.exp(x - x.max(-1, keepdims=True)), LEAST)) / w.sum(-1, keepdims=True)
    return means.reshape(k, d), np.maximum(np.exp(np.clip(var, -50.0, 50.0)).reshape(k, d), VAR_FLOOR), share(st), share(tr.reshape(k, k))


def _slopes(v: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The likelihood's gradient at ``_logs`` of the model's parameters, from the expected counts there, and its curvature along
    each of them if the states were known."""
    k, d = m.means.shape
    n, sx, sq, xi, st = np.split(v[:-1], np.cumsum([k, k * d, k * d, k * k]))
    n, sx, sq, xi = n[:, None], sx.reshape(k, d), sq.reshape(k, d), xi.reshape(k, k)
    mu, rows = m.means - m.means.mean(0), xi.sum(1, keepdims=True)
    off = sq - 2 * mu * sx + n * mu**2
    g = [(sx - n * mu) / m.vars, 0.5 * (off / m.vars - n), st - st.sum() * m.start, xi - rows * m.trans]
    h = [n / m.vars, np.repeat(n / 2, d, 1), st.sum() * m.start, rows * m.trans]
    return np.concatenate([x.ravel() for x in g]), np.concatenate([np.maximum(x, 1e-3).ravel() for x in h])


#: Rows of whole sequences on which large fits begin; differences kept of earlier steps; plain rounds before the first quasi-Newton step.
BEGIN_ROWS, MEMORY, PLAIN_FIRST = 200_000, 20, 5


class _Ascent:
    """Climb of one model with one set of parameters a pass.

    The expected counts give the gradient as well as EM's next round. Quasi-Newton steps (limited memory, scaled by the complete
    data's curvature) lead on; one that does not raise the likelihood enough is shortened, and given up for the plain
    round after a few tries. So no step lowers the likelihood, and as with ``_Climb`` the end is a plain round that changes it by less
    than ``tol``.
    """

    def __init__(self, model: Model, max_iter: int, tol: float):
        self.m, self.max_iter, self.tol = model, max_iter, tol
        self.z, self.steps, self.turns = None, [], []
        self.first, self.plain, self.trial = PLAIN_FIRST, True, model.params()

    def wanted(self) -> list[Model]:
        p = self.trial
        return [replace(self.m, means=p[0], vars=p[1], start=p[2], trans=p[3])]

    def go_on(self, z: np.ndarray, steps: list, turns: list) -> None:
        """Begin again at ``z`` with differences seen elsewhere."""
        m = self.m
        m.loglik, m.rounds, m.converged, m.occupancy, m.history = float("nan"), 0, False, None, []
        self.z, self.steps, self.turns, self.first, self.plain, self.trial = None, steps, turns, 1, True, _place(z, m.k)
        m.set(self.trial)

    def _direction(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        q, known = g.copy(), list(zip(self.steps, self.turns, strict=True))
        along = []
        for s, y in known[::-1]:
            along.append((s @ q) / (s @ y))
            q -= along[-1] * y
        r = q / h
        if known:
            s, y = known[-1]
            r *= (s @ y) / (y @ (y / h))
        for (s, y), a in zip(known, along[::-1], strict=True):
            r += s * (a - (y @ r) / (s @ y))
        return r

    def take(self, counts: list[np.ndarray]) -> bool:
        """The counts at the wanted parameters; sets the next ones. True when the fit has ended."""
        m, v = self.m, counts[0]
        m.rounds += 1
        ll = float(v[-1])
        if not self.plain and not ll >= m.loglik + 1e-4 * self.length * self.slope - 0.1 * self.tol:
            if m.rounds >= self.max_iter:
                m.set(self.em)
                return True
            self.length *= 0.3
            self.plain = self.length < 0.02
            if self.plain:
                self.steps, self.turns = [], []
            self.trial = self.em if self.plain else _place(self.z + self.length * self.way, m.k)
            return False
        gain = ll - m.loglik if m.history else np.inf
        m.set(self.trial)
        m.loglik, m.occupancy = ll, v[: m.k]
        m.history.append(ll)
        z, (g, h), self.em = _logs(self.trial), _slopes(v, m), _m_step(v, m)
        m.converged = self.plain and abs(gain) < self.tol
        if m.converged or m.rounds >= self.max_iter:
            m.set(self.em)
            return True
        if self.z is not None:
            s, y = z - self.z, self.g - g
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.steps, self.turns = [*self.steps, s][-MEMORY:], [*self.turns, y][-MEMORY:]
        self.z, self.g = z, g
        self.plain = abs(gain) < self.tol or len(m.history) < self.first
        if not self.plain:
            way = self._direction(g, h)
            if not g @ way > 0:
                self.steps, self.turns, way = [], [], g / h
            wide = np.concatenate([np.sqrt(m.vars).ravel(), np.ones(len(z) - m.means.size)])
            self.way = way * min(1.0, 2.0 / max(float(np.abs(way / wide).max()), 1e-300))  # at most two deviations, or a factor of e squared
            self.slope, self.length = float(g @ self.way), 1.0
        self.trial = self.em if self.plain else _place(z + self.way, m.k)
        return False


def _begin(table: DataFrame, keys: list[str], climbs: list[_Ascent], dims: int, total: int) -> None:
    """Brings climbs near their ends on some BEGIN_ROWS rows of whole sequences, each in a task of its own, for a start: they go on over
    all rows from there, with the differences of steps seen here."""
    some = table.where("blocks = 1 and n > 1").where(F.pmod(F.xxhash64(*keys, F.lit("begin")), F.lit(total // BEGIN_ROWS)) == 0)

    def climb(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c, batches = climbs[key[0].as_py()], rows.drop_columns(["model"]).to_batches()
        n = sum(int(np.asarray(b.column("n"))[np.asarray(b.column("fold")) != (-2 if c.m.leave_out is None else c.m.leave_out)].sum()) for b in batches)
        while n and not c.take([_sum_counts(batches, c.wanted(), dims)[0]]):
            pass
        flat = np.concatenate([[n], _logs(c.m.params()), *c.steps, *c.turns])
        return pa.table({"model": [key[0].as_py()], "v": [flat.tolist()]}, schema=pa.schema([("model", pa.int32()), ("v", pa.list_(pa.float64()))]))

    each = some.select(F.explode(F.sequence(F.lit(0), F.lit(len(climbs) - 1))).alias("model"), "n", "fold", "x")
    for r in each.repartitionByRange(len(climbs), "model").groupBy("model").applyInArrow(climb, "model int, v array<double>").collect():
        c, n = climbs[r.model], r.v[0]
        if n:
            width = len(_logs(c.m.params()))
            z, *seen = np.array(r.v[1:]).reshape(-1, width)
            c.go_on(z, seen[: len(seen) // 2], [y * (c.m.n_rows / n) for y in seen[len(seen) // 2 :]])


def _fit_large(table: DataFrame, keys: list[str], models: list[Model], dims: int, max_iter: int, tol: float, long: bool, total: int) -> list[Model]:
    """A pass for all models that are still climbing; models that start alike but for the order of their states climb once."""
    alike: dict[tuple, list[Model]] = {}
    for m in models:
        by = np.lexsort(m.means.T)
        alike.setdefault((m.k, m.leave_out, m.means[by].tobytes(), m.vars[by].tobytes()), []).append(m)
    climbs = [_Ascent(ms[0], max_iter, tol) for ms in alike.values()]
    if total >= 2 * BEGIN_ROWS:
        _begin(table, keys, climbs, dims, total)
    while climbs:
        counts = _pass(table, keys, [c.wanted()[0] for c in climbs], dims, long)
        climbs = [c for c, v in zip(climbs, counts, strict=True) if v is not None and not c.take([v])]
    for first, *others in alike.values():
        _in_order(first)
        for m in others:
            m.set(first.params())
            m.loglik, m.rounds, m.converged, m.occupancy, m.history = first.loglik, first.rounds, first.converged, first.occupancy, first.history
    return models


def fit_packed(table: DataFrame, keys: Sequence[str], models: list[Model], dims: int, max_iter: int = 200, tol: float = 1e-5) -> list[Model]:
    """Fit all models on a packed table (read from storage), each pass for all that are not done.

    The start is K-means over START_ROWS rows with the least hash, of the groups the model may see.
    EM ends when a plain round changes the log likelihood by less than ``tol``, or after ``max_iter`` passes.
    Sequences of one row do not count. Over ROWS_IN_A_TASK rows the steps between are quasi-Newton ones.
    """
    keys = list(keys)
    facts = table.groupBy("fold").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).when(F.col("blocks") > 1, F.col("n")).otherwise(0)).alias("n"), F.max("blocks").alias("b")).collect()
    long = any(r["b"] > 1 for r in facts)
    points = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("x", i * dims + 1, dims))
    rows = table.select("fold", F.xxhash64(*keys, "block").alias("h"), F.posexplode(points).alias("i", "p"))  # without x, which would be copied a row
    folds = sorted(r["fold"] for r in facts) if any(m.leave_out is not None for m in models) else [None]
    seen = {f: np.array([r["p"] for r in (rows if f is None else rows.where(F.col("fold") == f)).orderBy(F.xxhash64("h", "i"), "h", "i").limit(START_ROWS).select("p").collect()], float).reshape(-1, dims) for f in folds}
    for m in models:
        m.n_rows = sum(r["n"] for r in facts if m.leave_out is None or r["fold"] != m.leave_out)
        x = np.concatenate([v for f, v in seen.items() if f is None or f != m.leave_out])
        if len(x) < m.k:
            raise ValueError("fewer rows than states")
        label = _kmeans(x, m.k, np.random.default_rng(m.seed))
        m.means = np.array([x[label == j].mean(0) if (label == j).any() else x.mean(0) for j in range(m.k)])
        m.vars = np.array([np.maximum(x[label == j].var(0) if (label == j).any() else x.var(0), VAR_FLOOR) for j in range(m.k)])
        m.start, m.trans = np.full(m.k, 1 / m.k), np.full((m.k, m.k), 1 / m.k)
        m.history, m.rounds, m.converged = [], 0, False
    if not long and table.rdd.getNumPartitions() == 1:
        return _fit_in_tasks(table, models, dims, max_iter, tol)
    total = sum(r["n"] for r in facts)
    if total > ROWS_IN_A_TASK:
        return _fit_large(table, keys, models, dims, max_iter, tol, long, total)
    climbs = [_Climb(m, max_iter, tol) for m in models]
    while climbs:
        trials = [c.wanted() for c in climbs]
        counts = iter(_pass(table, keys, [t for ts in trials for t in ts], dims, long))
        got = [[next(counts) for _ in ts] for ts in trials]
        climbs = [c for c, v in zip(climbs, got, strict=True) if v[0] is not None and not c.take(v)]
    return [_in_order(m) for m in models]


def _in_order(m: Model) -> Model:
    by = np.argsort(m.means[:, 0], kind="stable")
    m.means, m.vars, m.start, m.trans, m.occupancy = m.means[by], m.vars[by], m.start[by], m.trans[by][:, by], m.occupancy[by]
    return m


def _fit_in_tasks(table: DataFrame, models: list[Model], dims: int, max_iter: int, tol: float) -> list[Model]:
    """The same passes where one task holds all sequences anyway (the table is one input split): each model's rounds
    run in a task of their own (by ranges: hashes would put several models into one task), so a fit is one job."""

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        m = models[key[0].as_py()]
        climb, batches = _Climb(m, max_iter, tol), rows.drop_columns(["model"]).to_batches()
        while True:
            trials = climb.wanted()
            if len(trials) > 1:  # only the likeliest one's counts are needed
                got = _sum_counts(batches, trials, dims, _likelihoods)
                best = climb.likeliest([got[i] for i in range(len(trials))]) if got else 0
                got |= {best: v for v in _sum_counts(batches, [trials[best]], dims).values()}
            else:
                got = _sum_counts(batches, trials, dims)
            if not got or climb.take([got[i] for i in range(len(trials))]):
                break
        flat = [m.means.ravel(), m.vars.ravel(), m.start, m.trans.ravel(), np.zeros(m.k) if m.occupancy is None else m.occupancy, [m.loglik, m.rounds, m.converged], m.history]
        return pa.table({"model": [key[0].as_py()], "v": [np.concatenate(flat).tolist()]}, schema=pa.schema([("model", pa.int32()), ("v", pa.list_(pa.float64()))]))

    each = table.where("blocks = 1 and n > 1").select(F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))).alias("model"), "n", "fold", "x")
    for r in each.repartitionByRange(len(models), "model").groupBy("model").applyInArrow(fit, "model int, v array<double>").collect():
        m = models[r.model]
        k, d = m.k, dims
        means, var, start, trans, occupancy, (m.loglik, rounds, done), history = np.split(np.array(r.v), np.cumsum([k * d, k * d, k, k * k, k, 3]))
        m.set((means.reshape(k, d), var.reshape(k, d), start, trans.reshape(k, k)))
        m.occupancy, m.rounds, m.converged, m.history = occupancy, int(rounds), bool(done), history.tolist()
    return [_in_order(m) for m in models if m.history]


def _paths(e, live, model: Stack):
    """The likeliest state path of each sequence under the first model (log scores)."""
    with np.errstate(divide="ignore"):
        log_e, log_a = np.log(np.maximum(e[:, 0].transpose(0, 2, 1), 1e-300)), np.log(model.trans[0])
        v = np.log(model.start[0])[None] + log_e[0]
    back = np.zeros(log_e.shape, np.int16)
    end = np.zeros(log_e.shape[1:])
    for t, m in enumerate(live):
        if t:
            w = v[:m, :, None] + log_a[None]
            back[t, :m] = w.argmax(1)
            v = w.max(1) + log_e[t, :m]
        end[:m] = v[:m]
    state = np.zeros(log_e.shape[:2], np.int64)
    now = end.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        on = live[t + 1] if t + 1 < len(live) else 0
        if on:
            now[:on] = back[t + 1, np.arange(on), state[t + 1, :on]]
        state[t, : live[t]] = now[: live[t]]
    return state


def decoded(table: DataFrame, keys: Sequence[str], models: list[Model], dims: int, keep: Sequence[str]) -> DataFrame:
    """(model, keys, keep, state, probability): the likeliest path of every sequence under every model that may see it,
    and the posterior probability of each of its states."""
    keys = list(keys)
    ks = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keys)
    out = f"model int, {ks}, keep {table.schema['keep'].dataType.simpleString()}, state array<long>, probability array<double>"

    def run(batches):
        for batch in batches:
            for part, n in _portions(batch, dims):
                x = _grid(part.column("x"), n, dims)
                fold = np.asarray(part.column("fold"))
                for j, m in enumerate(models):
                    some = np.flatnonzero(fold != m.leave_out) if m.leave_out is not None else np.arange(len(n))
                    if not len(some):
                        continue
                    mine, length = part.take(pa.array(some)), n[some]
                    one = Stack([m])
                    _, e, _, live, *_, g = _posterior(mine, length, x[: int(length.max()), some], one)
                    state = _paths(e, live, one)
                    p = np.take_along_axis(g[:, 0], state[:, None], 1)[:, 0]
                    cells = [pa.array([v[:q, i].tolist() for i, q in enumerate(length.tolist())]) for v in (state, p)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), j, np.int32)), *[mine.column(c) for c in [*keys, "keep"]], *cells], ["model", *keys, "keep", "state", "probability"])

    got = table.where("blocks = 1").select(*keys, "n", "fold", "x", "keep").mapInArrow(run, out)
    rows = got.select("model", *keys, F.inline(F.arrays_zip("keep", "state", "probability")))
    if not table.where("blocks > 1").isEmpty():
        for j, m in enumerate(models):
            rows = rows.unionByName(_decoded_long(table, keys, j, m, dims).select(*rows.columns))
    names = [F.col(f"keep.`{c}`").alias(c) for c in keep if c not in keys]
    return rows.select("model", *keys, *names, "state", "probability")


def _decoded_long(table: DataFrame, keys: list[str], j: int, m: Model, dims: int) -> DataFrame:
    """The same for sequences of several blocks: the path by blocks (``chains``), posteriors from the blocks' borders."""
    from gatherline.operators.chains import _best_path

    many = table.where("blocks > 1") if m.leave_out is None else table.where(F.col("blocks") > 1).where(F.col("fold") != m.leave_out)
    at = F.posexplode("keep").alias("_i", "keep")
    rows = many.select(*keys, F.col("block").cast("long").alias("_block"), "x", at).select(*keys, "_block", F.col("_i").cast("long").alias("_pos"), "keep", F.slice("x", F.col("_i") * dims + 1, dims).alias("_x"))
    log_a, log_s = np.log(m.trans), np.log(m.start)

    def emit(pdf):
        x = np.vstack(pdf["_x"].to_numpy()).astype(float)[:, None, :]
        e, top = Stack([m]).emissions(x)
        return np.log(np.maximum(e[:, 0, :, 0], 1e-300)) + top[:, 0]

    lean = rows.withColumn("_row", F.col("_pos")).select(*keys, "_block", "_pos", "_x")
    path = _best_path(lean, keys, emit, lambda k: log_a, lambda k: log_s)
    border = join_on(many, _transfers(many, keys, [m], dims), [*keys, "block"], "inner")

    def run(batches):
        for batch in batches:
            for part, n in _portions(batch, dims):
                *_, g = _posterior(part, n, _grid(part.column("x"), n, dims), Stack([m]))
                cells = pa.array([g[:q, 0, :, i].tolist() for i, q in enumerate(n.tolist())], pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in [*keys, "block", "keep"]], cells], [*keys, "block", "keep", "g"])

    ks = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keys)
    post = border.select(*keys, "block", "n", "x", "keep", "alpha", "beta").mapInArrow(run, f"{ks}, block int, keep {table.schema['keep'].dataType.simpleString()}, g array<array<double>>")
    post = post.select(*keys, F.col("block").cast("long").alias("_block"), F.posexplode(F.arrays_zip("keep", "g")).alias("_i", "_z")).select(*keys, "_block", F.col("_i").cast("long").alias("_pos"), "_z.keep", "_z.g")
    both = join_on(post, path, [*keys, "_block", "_pos"], "inner")
    return both.select(F.lit(j).alias("model"), *keys, "keep", F.col("_state").alias("state"), F.get("g", F.col("_state").cast("int")).alias("probability"))


# ------------------------------------------------------------------ what users call


def hidden_states(df: DataFrame, keys: Sequence[str], order: Sequence, features: Sequence[str], k: int, keep: Sequence[str] = (), seed: int = 0,
                  max_iter: int = 200, tol: float = 1e-5, block_rows: int | None = None) -> tuple[DataFrame, Model]:
    """State (on the likeliest path) and its posterior probability of every row, and the fitted model."""
    table = _spread(packed(df, keys, order, features, keep, block_rows=block_rows))
    (model,) = fit_packed(table, keys, [Model(k, seed)], len(features), max_iter, tol)
    return decoded(table, keys, [model], len(features), keep).drop("model"), model


def choose(df: DataFrame, keys: Sequence[str], order: Sequence, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), seeds: Sequence[int] = (42, 7, 99),
           max_iter: int = 200, tol: float = 1e-5) -> list[Model]:
    """The best seed (lowest BIC) of every number of states, lowest BIC first; all fits share their passes."""
    table = _spread(packed(df, keys, order, features))
    fits = fit_packed(table, keys, [Model(k, s) for k in ks for s in seeds], len(features), max_iter, tol)
    best = [min((m for m in fits if m.k == k), key=lambda m: m.bic) for k in ks]
    return sorted(best, key=lambda m: m.bic)


def state_stability(df: DataFrame, keys: Sequence[str], order: Sequence, features: Sequence[str], k: int, group: str, row_id: str, folds: int = 5,
                    min_rows: int = 4, max_iter: int = 200, tol: float = 1e-5) -> DataFrame:
    """fold, n_shared, ari, agreement: refit with a share of the groups left out and compare with the fit on all.

    Groups in order are dealt into ``folds`` neighbouring shares. The rows compared are those that the fold's model saw, in
    sequences of at least ``min_rows``; agreement is the share of equal states after the best matching of labels.
    """
    from gatherline.operators.stats import adjusted_rand, matched_agreement

    ids = df.select(group).where(F.col(group).isNotNull()).distinct()
    placed = ordered_scan(ids, [], [group], {"_no": row_no()})
    n = ids.count()
    fold = settle(placed.select(group, F.floor((F.col("_no") - 1) * folds / F.lit(max(n, 1))).cast("int").alias("_f")))
    d = join_on(df, fold, [group], "left").withColumn("_f", F.coalesce("_f", F.lit(-1)))
    keep = [row_id, "_f"]
    table = _spread(packed(d, [*keys], order, features, keep, F.col("_f")).where(F.col("n") + (F.col("blocks") - 1) * BLOCK_ROWS >= min_rows))
    models = fit_packed(table, keys, [Model(k, 0), *[Model(k, 1000 + f, f) for f in range(folds)]], len(features), max_iter, tol)
    rows = settle(decoded(table, keys, models, len(features), keep).select("model", F.col(row_id).alias("_id"), "state"))
    full = rows.where("model = 0").select("_id", "state")
    both = settle(rows.where("model > 0").select((F.col("model") - 1).alias("fold"), "_id", F.col("state").alias("other")).join(full, "_id"))
    ari = adjusted_rand(both, "state", "other", ["fold"]).withColumnRenamed("n", "n_shared")
    return join_on(ari, matched_agreement(both, "state", "other", ["fold"]).drop("n"), ["fold"])
