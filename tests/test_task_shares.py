"""What one task holds and what is shuffled do not grow with the input."""

import pytest

from gatherline.functions import text as T
from gatherline.operators import lexical, ordered, signals
from gatherline.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.fixture(scope="module")
def said(spark):
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(None, 0, "x y x y z"), (None, 1, None), (None, 2, "x y"), (-1, 0, "one"), (-2, 0, ""), (-3, 0, "a b a b " * 200)]
    return d.select("conv_id", "turn", "text").unionByName(spark.createDataFrame(rows, d.select("conv_id", "turn", "text").schema))


def test_ngrams_are_not_shuffled(spark):
    """only the texts of ngram_entropy are."""
    got = plan(catalog.QUERIES["ngram_entropy"](spark, SF))
    assert "hashpartitioning(doc_id" in got and "_item#" not in "".join(x for x in got.splitlines() if "Exchange" in x)


def test_turns_are_dealt_by_their_text(spark):
    """the number of tasks follows the text, and adaptive execution does not merge them."""
    got = plan(catalog.QUERIES["speaker_lexicon"](spark, SF))
    assert "REPARTITION_BY_NUM" in got


@pytest.mark.parametrize("per_task", [1_000, 1_500])
def test_ngrams_of_heavy_keys(said, per_task):
    d = said.withColumn("_words", T.tokens("text"))
    want = lexical.item_entropy(d, ["conv_id"], T.ngrams("_words", 2), "bigram")
    assert rows(lexical.text_ngrams(said, ["conv_id"], "text", 2, "bigram", per_task)) == rows(want)
    known = d.filter("conv_id IS NOT NULL")
    whole, few = (rows(lexical.stream_ngrams(known, ["conv_id"], ["turn"], "_words", "text", n)) for n in (10**9, per_task))
    assert whole == few and len(few) > 5
    marked, parts = lexical.sized(said, ["conv_id"], "text", per_task)
    assert parts > 1 and marked.filter("_heavy").count() >= 1 and marked.count() == said.count()


def test_vectors_are_dealt_once(spark):
    """the rows of vector_features are dealt by their number and stay there for the joins."""
    got = plan(catalog.QUERIES["vector_features"](spark, SF))
    shuffles = [x for x in got.splitlines() if "Exchange hashpartitioning" in x]
    assert any("_key" in x and "REPARTITION_BY_NUM" in x for x in shuffles) and not any("isnull(_key" in x and "_mag" in x for x in shuffles)


def test_vectors_without_key(spark):
    rows = [(k, i, float(i * i % 7), None if i % 5 == 0 else 1.0) for k in (None, 1, 2) for i in range(9)] + [(3, 0, None, None)]
    d = spark.createDataFrame(rows, "k long, i long, x double, y double")
    got = {r.k: r for r in signals.vector_features(d, ["k"], ["i"], ["x", "y"], 2.0, 3.0).collect()}
    assert list(got[1].asDict())[0] == "k" and len(got) == 4 and got[None][1:] == got[1][1:] == got[2][1:]
    assert got[1].motion_max > 4 and got[3].motion_mean == 0.0 and got[3].jerk_mean is None
    assert ordered.parts_of(d, 2) == max(14, spark.sparkContext.defaultParallelism)
