"""Every stage of the pipeline on odd rows: nulls, empty and long texts, repeated rows, clashing and dotted names, no rows."""

import pytest

import corpus_pipeline

NAMES = "doc_id long, text string, lang string, source string, n_chars long, `meta.url` string, rest_ string, row_ int, t string, k long, j1 long"


def _odd(spark):
    texts = ["The cat sat on the mat and looked at the dog in the house. " * 3, None, "", "   ", "é ü 日本語", "word " * 250_000, "password=q8Zk3vLx91 and so on with the rest of the words"]
    rows = [(None if i == 4 else i, t, "en", None, 0, "u", "r", i, "t", 5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[0]], NAMES)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_rows(spark, name, stage):
    docs = _odd(spark).repartition(3)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert {r.row_ for r in rows} <= set(range(7)) and all(r["meta.url"] == "u" and r.rest_ == "r" for r in rows)
    if name in ("suffix_array_dedup", "secret_scan"):
        assert len(rows) == 9
    if name == "secret_scan":
        assert "q8Zk3vLx91" not in " ".join(r.text or "" for r in rows)
    assert stage(spark, docs.where("false"), "").collect() == []


def test_packing_on_odd_rows(spark):
    docs = _odd(spark)
    out = corpus_pipeline.packed(spark, docs, "").collect()
    assert {r.doc_id for r in out} == {None, 0, 1, 2, 3, 5, 6} and min(r.length for r in out) > 0
    assert sum(r.length for r in out if r.doc_id == 5) == next(r.doc_tokens for r in out if r.doc_id == 5)
    assert corpus_pipeline.packed(spark, docs.where("false"), "").collect() == []


def test_forest_scores_by_a_plain_walk():
    import numpy as np

    from gatherline.llm import forest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(float)
    trees = [np.array(forest._grow(x, y, np.random.default_rng(i))).reshape(-1, 5) for i in range(6)]

    def walk(t, row):
        at = 0
        while t[at, 0] >= 0:
            at = int(t[at, 2] if row[int(t[at, 0])] <= t[at, 1] else t[at, 3])
        return t[at, 4]

    assert forest.predict(trees, x) == pytest.approx([np.mean([walk(t, r) for t in trees]) for r in x])
    assert ((forest.predict(trees, x) > 0.5) == y).mean() > 0.9
