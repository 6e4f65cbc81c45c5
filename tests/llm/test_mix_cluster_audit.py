"""Centroid clustering, source mixing and the filter audit: SQL on the smallest tables, plain versions on odd rows."""

import hashlib
import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from gatherline.llm import catalog, centroids, filter_audit, mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_clusters", "op12_mixing", "op13_filter_audit"])
def test_same_as_sql(spark, name):
    assert check.compare(catalog.QUERIES[name](spark, SF), check.connect(SF), catalog.ORACLES[name]) is None


# ------------------------------------------------------------------ clustering


def plain_clusters(rows, k, rounds):
    x = {i: [math.floor(int(v) * 256 if abs(v) > 2**60 else v * 256) for v in vec] for i, vec in rows}
    start = sorted((i for i in x if i is not None), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]
    c = [x[i] for i in start]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, q)), j) for j, q in enumerate(c)))
    for _ in range(rounds):
        at = {i: near(v)[1] for i, v in x.items()}
        for j in range(len(c)):
            mine = [x[i] for i in x if at[i] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return {i: (near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, c[near(v)[1]])).encode()).hexdigest()) for i, v in x.items()}


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(round(v, 1)) for v in rng.normal(i % 3, 0.3, 4)]) for i in range(40)]
    good += [(100, good[0][1]), (None, good[1][1]), (101, [1e7, -1e9, 0.0, 1.0]), (102, [-0.001, 0.0, 0.001, 5e-324])]
    bad = [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0])]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, label int, `meta.v` string")
    got = {r.vec_id: r for r in centroids.clusters(d.repartition(5), k=6, rounds=3, dims=4).collect()}
    want = plain_clusters(good, 6, 3)
    assert set(got) == set(want)
    assert {i: (r.cluster, r.distance, r.centroid_sha256) for i, r in got.items()} == want
    for r in got.values():
        assert r.cluster_inertia == sum(w[1] for w in want.values() if w[0] == r.cluster) and r.inertia == sum(w[1] for w in want.values())


def test_clusters_ties_repeats_and_empty(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = centroids.clusters(d, k=2, rounds=0, dims=2).collect()
    assert len(got) == 4 and len({(r.vec_id, r.cluster) for r in got}) == 3
    planes = centroids.Bisectors([[0, 0], [4, 0], [2, 2], [0, 0]])
    assert planes.nearest(np.array([[2, 0], [0, 0], [4, 1]])).tolist() == [0, 0, 1]
    assert centroids.clusters(d.where("false"), dims=2).collect() == []
    nobody = centroids.clusters(d.withColumn("vec_id", F.lit(None).cast("long")), dims=2).collect()
    assert len(nobody) == 4 and all(r.cluster is None for r in nobody)
    far = spark.createDataFrame([(1, [1e19, 0.0]), (2, [-1e19, 0.0])], "vec_id long, embedding array<double>")
    assert [r.distance for r in centroids.clusters(far, k=1, rounds=0, dims=2).orderBy("distance").collect()] == [None, 0]


# ------------------------------------------------------------------ mixing

ODD = [
    (1, "one two three", "b"), (2, "", "b"), (3, None, "b"), (None, "x y", "b"), (None, "z w", "b"), (4, " lead and trail\x0b ", None),
    (5, "dup dup", "a"), (5, "dup dup", "a"), (5, "dup dup", "a"), (6, "word " * 5000, "c"), (7, "é ü 日本", "c"), (8, "   ", "z"), (9, "q " * 40, "d"),
]


def plain_shares(rows, packet, weights=(1, 2, 3), most=3):
    words = lambda t: sum(1 for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in (t or "")).split(" ") if w)
    entry = {}
    for d, t, s in rows:
        entry[s, d, words(t)] = entry.get((s, d, words(t)), 0) + 1
    size = {}
    for (s, _, w), n in entry.items():
        size[s] = size.get(s, 0) + w * n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, rest, free = {}, sum(size.values()), set(names)
    while free:
        share = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > most * size[s]]
        if not over:
            goal |= {s: rest * weight[s] / share for s in free}
            break
        goal |= {s: most * size[s] for s in over}
        rest, free = rest - sum(most * size[s] for s in over), free - set(over)
    packets = []
    for i, s in enumerate(names):
        at = 0
        for p in range(most):
            mine = sorted((hashlib.md5(f"{p}:{'' if k[1] is None else k[1]}".encode()).hexdigest(), k[1] is not None, k[1] or 0, k[2]) for k in entry if k[0] == s)
            for _, known, d, w in mine:
                k = (s, d if known else None, w)
                for lo in range(0, w * entry[k], packet):
                    m = min(packet, w * entry[k] - lo)
                    packets.append(((at + lo + m) / goal[s], i, at + lo + m, m, k, p, lo))
                at += w * entry[k]
    left, got = sum(size.values()), {}
    for _, _, _, m, k, p, lo in sorted(packets, key=lambda x: x[:3]):
        for at in range(lo, lo + min(m, left)):  # word by word
            got[k, at // k[2]] = got.get((k, at // k[2]), 0) + 1
        left -= min(m, left)
    return sorted((repr(k), j, goal[k[0]], got.get((k, j), 0)) for k, n in entry.items() for j in range(n))


@pytest.mark.parametrize("packet,bucket,ranges", [(512, 50_000, 10**6), (7, 2, 50)])
def test_shares_of_odd_rows(spark, monkeypatch, packet, bucket, ranges):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "RANGE", ranges)
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], "doc_id long, text string, source string, size int, `meta.url` string, at int")
    got = mixing.shares(d.repartition(3), packet=packet).collect()
    assert sorted((repr((r.source, r.doc_id, r["size"])), r.instance, r.target, r.taken) for r in got) == [
        (k, j, pytest.approx(g), t) for k, j, g, t in plain_shares(ODD, packet)
    ]
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_mix_texts(spark):
    d = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, source string, `meta.url` string")
    plan = mixing.shares(d).collect()
    out = mixing.mixed(d)
    assert out.columns == d.columns
    rows = out.withColumn("n", mixing.size_of(F.col("text"))).collect()
    assert sum(r.n for r in rows) == sum(r.taken for r in plan)
    texts = {(r.doc_id, r.source): r.text for r in d.collect() if r.doc_id is not None}
    assert all(texts[r.doc_id, r.source].startswith(r.text) for r in rows if r.doc_id is not None)
    assert mixing.shares(d.where("false")).collect() == [] and mixing.mixed(d.where("false")).collect() == []
    nothing = mixing.shares(d.where("doc_id in (2, 3, 8)")).collect()
    assert len(nothing) == 3 and all(r.taken == 0 and r.target == 0.0 for r in nothing)


def test_targets():
    assert mixing.targets([("a", 10), ("b", 1), (None, 9)]) == {"b": 3.0, "a": 17 / 4, None: 17 * 3 / 4}
    assert mixing.targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0} and mixing.targets([]) == {}


# ------------------------------------------------------------------ audit

TEXTS = [
    (1, "word " * 250, "s"), (2, "word " * 250, "s"), (3, " ".join(f"w{i}" for i in range(300)), "s"), (4, "ABC $ d", "t"), (5, None, "t"), (6, "", None),
    (6, "", None), (None, "", "t"), (None, "ABC $ d", ""), (0, "ABC $ d", "u"), (7, "é" * 9 + "Ä", "u"), (8, "UP " + "low " * 400, "u"), (9, "z" * 70_000, "u"),
]


def plain_audit(rows, labels):
    gap = "\x20\t\n\x0b\x0c\r"
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in gap else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in rows)
        docs.append((s or "", fails, *labels.get(d, (0, 0))))
    out = set()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shap, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in mine if d[1][f]]
                shap[f] += len(gone)
                alone = sum(not any(v for g, v in d[1].items() if g != f) for d in failing)
                lines.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out |= {(*x[:-1], shap[x[-1]]) for x in lines}
    return out


@pytest.mark.parametrize("heavy,batch", [(1000, 10_000), (3, 2)])
def test_audit_of_odd_rows(spark, monkeypatch, heavy, batch):
    monkeypatch.setattr(filter_audit, "HEAVY", heavy)
    monkeypatch.setattr(filter_audit, "_PARTS_HELD", 1)
    d = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, source string, fails int, `a.b` string").repartition(4)
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (6, None, 1), (None, 1, 1), (77, 1, 1)]
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in filter_audit.audit(d, l).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_audit(TEXTS, {1: (1, 0), 2: (1, 1), 4: (1, 1), 6: (0, 1)}) and len(got) == 4 * 600
    assert filter_audit.audit(d.where("false"), l).collect() == []
    assert filter_audit.audit(d, l.where("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_sorted_lists():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(0, 12))) for _ in range(2))
        assert filter_audit._union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()}) and filter_audit._minus(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
