"""What the review of round 3 found, each against SQL or a plain version."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from gatherline.functions import lexicons as L
from gatherline.functions import text as T
from gatherline.operators import chains, hmm, intervals, learn, stats, windows
from gatherline.streaming import streams

SF = "/root/testdata/sf0.001"


def _with_table(tmp_path, name, sql):
    """A copy of the smallest tables in which ``name`` comes from ``sql`` over the old one ({t})."""
    for t in check.TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.execute(f"COPY ({sql.format(t=f"'{SF}/{name}.parquet'")}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def _same(spark, sf, name):
    return check.compare(entry.queries()[name](spark, sf), check.connect(sf), entry.oracle_sql()[name])


TEXTS = ["noë", "éno", "butê wait", "ça stop", "öagree", "yeahé", "ok\x0b", "ok\n", "right.\n", "wir letsé", "was. whoé", "we couldé go", "a\x0bb c d yes", "trails...\n", "trails..."]


def test_f3_patterns_as_sql_reads_them(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, x string").orderBy("i")
    got = [tuple(r) for r in df.select(T.has_support("x"), T.has_conflict("x"), T.trails_off("x"), T.suggestion_count("x")).collect()]
    q = lambda s: s.replace("'", "''")
    sup = f"(regexp_matches(lower(x), '{q(L.SUPPORT)}') OR (len(regexp_split_to_array(trim(x), '\\s+')) <= 4 AND regexp_matches(trim(x), '(?i){q(L.SHORT_SUPPORT)}')))"
    con = f"(regexp_matches(lower(x), '{q(L.CONFLICT[0])}') OR regexp_matches(lower(x), '{q(L.CONFLICT[1])}'))"
    n = f"len(regexp_extract_all(x, '(?i)({q('|'.join(L.SUGGESTION_PATTERNS))})'))"
    want = [duckdb.execute(f"SELECT {sup}, {con}, regexp_matches(x, '{L.TRAILS_OFF}'), {n} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone() for t in TEXTS]
    assert got == want and any(w[1] for w in want)


@pytest.mark.parametrize("name", ["context_labels", "speaker_lexicon"])
def test_f3_accents_and_missing_texts(spark, tmp_path, name):
    odd = "CASE conv_id % 4 WHEN 0 THEN 'noë ' || text WHEN 1 THEN text || ' éwait' ELSE text END"
    if name == "context_labels":
        odd = f"CASE WHEN (conv_id + turn) % 7 <> 3 THEN {odd} END"
    assert _same(spark, _with_table(tmp_path, "conversations", f"SELECT * REPLACE ({odd} AS text) FROM {{t}}"), name) is None


def test_f4_least_overlaps(spark):
    rows = [("k", i, w, a, z) for i, (w, a, z) in enumerate([("A", 0.0, 5.0), ("B", 5.0 - 1e-12, 9.0), ("A", 9.0, 12.0), ("C", 12.0, 13.0), ("C", 1e5, 1e5 + 2), ("C", 1e5 + 1, 1e5 + 3)])]
    d = spark.createDataFrame(rows, "k string, id int, who string, a double, z double").repartition(3)
    got = {r.id: r.covered_s for r in intervals.covered_seconds(d, d, ["k"], "id", ("a", "z"), "who").collect()}
    assert set(got) == {0, 1} and all(0 <= v < 1e-9 for v in got.values())


def test_f4_covered_by_others_without_length(spark, tmp_path):
    stamp = "ts - to_microseconds(CAST(epoch_us(ts) % 6000000 AS BIGINT))"
    sf = _with_table(tmp_path, "events", f"SELECT * REPLACE ({stamp} AS ts, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE value * 10 END AS value) FROM {{t}}")
    assert _same(spark, sf, "covered_by_others") is None


def test_f6_speakers_without_length(spark, tmp_path):
    sf = _with_table(tmp_path, "events", "SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS value) FROM {t}")
    assert _same(spark, sf, "transcript_windows") is None


def test_f7_tables_of_several_files(spark, tmp_path):
    for t in check.TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(tuple(r) for r in entry.queries()["file_union_provenance"](spark, SF).collect())
    assert sorted(tuple(r) for r in entry.queries()["file_union_provenance"](spark, f"{tmp_path}/").collect()) == want
    assert {r[0] for r in want} == {"documents.parquet"}


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_f1_windows_across_batches(spark, per_batch):
    rows = [(k, w, float(i)) for k in (1, 2, None) for w in range(5) for i in range(1 + 4 * w)]
    d = spark.createDataFrame(rows, "k int, window_index long, x double").repartition(5)
    calls = spark.sparkContext.accumulator(0)

    def fn(g):
        calls.add(1)
        if g["window_index"].iat[0] == 3:
            return g[["k", "window_index"]].head(2).assign(n=len(g), total=g["x"].sum())
        return g["k"].iat[0], g["window_index"].iat[0], len(g), g["x"].sum()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        df = windows.window_apply(d, ["k"], fn, "k int, window_index long, n long, total double")
        got = sorted((tuple(r) for r in df.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = lambda w: 1 + 4 * w
    want = [(k, w, size(w), sum(range(size(w))) * 1.0) for k in (1, 2, None) for w in range(5) for _ in range(1 + (w == 3))]
    assert got == sorted(want, key=str) and calls.value == 15
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()  # one call of a worker a window


def test_f2_f10_f16_f18_sequences_are_spread(spark, monkeypatch):
    df = spark.createDataFrame([(k, t, float((k * 7 + t * t) % 5 + 4 * (t // 5 % 2))) for k in range(40) for t in range(20)], "k int, t int, x double")
    fits = []
    for most in (10_000, 100):
        monkeypatch.setattr(hmm, "ROWS_IN_A_TASK", most)
        table = hmm._spread(hmm.packed(df, ["k"], ["t"], ["x"]))
        assert table.rdd.getNumPartitions() == 1 if most > 800 else table.rdd.getNumPartitions() >= 8
        fits.append(hmm.fit_packed(table, ["k"], [hmm.Model(2), hmm.Model(3, 1), hmm.Model(3, 2)], 1, max_iter=30))
    for a, b in zip(*fits):
        assert a.loglik == pytest.approx(b.loglik, abs=1e-6) and a.rounds == b.rounds and a.means == pytest.approx(b.means, abs=1e-6)


def test_f9_short_sequences_without_a_call_each(spark):
    rows = [(k, t, [-abs(((k * 3 + t * t) % 7) - c) * 1.0 for c in (0, 3, 6)]) for k in range(12) for t in range(1 + k)] + [(None, 0, [0.0, -1.0, -2.0])]
    d = spark.createDataFrame(rows, "k int, t int, lp array<double>").repartition(4)
    calls = spark.sparkContext.accumulator(0)
    lean = chains._with_chain_blocks(d, ["k"], ["t"], None).select("k", "_pos", "_block", F.col("lp").alias("_lp"))

    def emit(pdf):
        calls.add(1)
        return np.vstack(pdf["_lp"].to_numpy()).astype(float)

    trans = lambda k: np.where(np.eye(k, dtype=bool), 0.0, -1.5)
    got = {(r.k, r._pos): r._state for r in chains._best_path(lean.coalesce(1), ["k"], emit, trans, np.zeros).collect()}
    assert len(got) == len(rows) and calls.value < 13
    want = {(r.k, r._pos): r._state for r in chains._long_paths(lean, ["k"], emit, trans, np.zeros).collect()}
    assert got == want


def test_f11_f12_no_sketch_beside_a_distinct_count(spark, monkeypatch):
    seen, plain = [], stats.agg_with_percentiles

    def spy(df, keys, aggs, spec):
        seen.append(df.groupBy(*keys).agg(*aggs)._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, keys, aggs, spec)

    monkeypatch.setattr(stats, "agg_with_percentiles", spy)
    got = {r.feature: r for r in stats.feature_inventory(spark.range(9).selectExpr("id % 4 AS a", "nullif(id, 3) AS b"), ["a", "b"]).collect()}
    assert "distinct" not in seen[0].lower() and (got["a"].n_unique, got["b"].n_unique, got["b"].n) == (4, 8, 8)
    assert list(got["a"].asDict())[-3:] == ["n_unique", "median", "iqr"]


def test_f8_ranks_of_complete_rows_without_a_row_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "a": rng.integers(0, 9, 400) * 1.0, "b": rng.normal(size=400), "c": 2.0})
    pdf["c"] = pdf["c"].where(pdf["k"] == 0, pdf["a"] * pdf["b"])
    for i, c in enumerate("abc"):
        pdf.loc[rng.random(400) < 0.1 * (i + 1), c] = np.nan
    d = spark.createDataFrame([[None if isinstance(x, float) and np.isnan(x) else x for x in r] for r in pdf.values.tolist()], "k double, a double, b double, c double")
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    read, plain = [], stats.settle

    def spy(df):
        read.append(df.count())
        return plain(df)

    monkeypatch.setattr(stats, "settle", spy)
    for sent in (100_000, 0):
        monkeypatch.setattr(stats, "RANKS_SENT", sent)
        got = {(r.k, r.a, r.b): (r.n, r.rho) for r in stats.spearman_table(d, ["k"], pairs, rows_per_block=40).collect()}
        for (k, a, b), (n, rho) in got.items():
            x = pdf[pdf["k"] == k][[a, b]].dropna()
            want = x[a].rank().corr(x[b].rank())
            assert n == len(x) and (rho is None if (k, "c") in ((0, a), (0, b)) else rho == pytest.approx(want))
        assert len(got) == 9
    assert max(read) <= len(pdf) * 2  # rows, and distinct values of each column; not the rows of each pair


def test_f14_predictions_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def pred(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(p=pdf["y"] * 2 + pdf["i"] % 3)

    d = spark.range(200).selectExpr("id AS i", "cast(id % 50 AS double) AS y").mapInPandas(pred, "i long, y double, p double")
    r = learn.regression_scores(d, "y", "p").first()
    y = pd.Series([i % 50 * 1.0 for i in range(200)])
    p = y * 2 + pd.Series(range(200)) % 3
    assert seen.value == 200
    assert r.n == 200 and r.rho == pytest.approx(y.rank().corr(p.rank())) and r.mae == pytest.approx((y - p).abs().mean()) and r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / (y.var(ddof=0) * 200))


def test_f19_one_call_serves_many_keys(spark, tmp_path, monkeypatch):
    rows = [(None if k == 0 else 2**53 + k, 1e6 + t * 10.0, (t + k) % 4 > 0) for k in range(60) for t in range(30)] + [(-1, 2e6, False)]
    d = spark.createDataFrame(rows, "k long, t double, f boolean").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    d.coalesce(1).write.parquet(f"{tmp_path}/e")
    calls, plain = spark.sparkContext.accumulator(0), streams._runs_of

    def counted(keys, idle):
        fn = plain(keys, idle)

        def call(key, batches, state):
            calls.add(1)
            yield from fn(key, batches, state)

        return call

    monkeypatch.setattr(streams, "_runs_of", counted)
    monkeypatch.setattr(streams, "RUN_BUCKETS", 4)
    s = streams.read_events(spark, f"{tmp_path}/e")
    got = streams.run_available(streams.flag_runs(s, ["k"], "t", F.col("f"), "1 second", 600.0), f"{tmp_path}/w", rocks=True)
    want = []
    for k in dict.fromkeys(r[0] for r in rows):
        run = []
        for _, t, f in [r for r in rows if r[0] == k] + [(k, 0.0, False)]:
            if not f and run:
                want.append((k, run[0], run[-1], len(run)))
            run = [*run, t] if f else []
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert calls.value <= 12


def test_f20_equal_vectors_are_one(spark, monkeypatch):
    from pyspark.ml.clustering import GaussianMixture

    d = spark.range(3000).selectExpr("cast(id % 7 + 40 * (id % 10 div 6) AS double) AS a", "cast(id % 5 AS double) AS b")
    fitted, plain = [], GaussianMixture.fit

    def fit(self, df, *args):
        fitted.append((df.count(), df.groupBy().sum(self.getWeightCol()).first()[0]))
        return plain(self, df, *args)

    monkeypatch.setattr(GaussianMixture, "fit", fit)
    r = learn.gaussian_mixture(learn.assemble(d, ["a", "b"], "features"), "features", 2)
    n = {(x.far, x.cluster): x["count"] for x in r.groupBy((F.col("a") >= 40).alias("far"), "cluster").count().collect()}
    assert fitted == [(d.distinct().count(), 3000.0)]
    assert len(n) == 2 and {f: c for (f, _), c in n.items()} == {False: 1800, True: 1200}
