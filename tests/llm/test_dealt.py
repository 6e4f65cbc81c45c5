"""The contract queries on the smallest tables and on hand-made rows, against plain versions."""

import pytest
from pyspark.sql import functions as F

from gatherline.llm import catalog, components, lang_id, packing, simhash, suffix_dedup, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, score double"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def odd(spark, texts, start=0):
    return spark.createDataFrame([(None if i == 2 else start + i, t, "en", "s", 0, "x", "y", 0.5) for i, t in enumerate(texts)], ODD)


LONG = "Words that go on, é and on. " * 3000
TEXTS = ["one two three four five six", "", "null id", None, "   \n\t", "日本語 text with 'quotes' it's", "same same", "same same", LONG, "A\x1cb", "<|endoftext|> x"]


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 100), (7, None), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    want = brute.components(range(0, 301), [(a, b) for a, b in path if b is not None])
    assert got == {n: want[n] for n in got} and set(got) == {*range(61), 100, 101, 102, 200, 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(spark, documents, rows):
    got = sorted(tuple(r) for r in catalog.QUERIES["op2_suffix_dedup"](spark, SF).collect())
    want = sorted(brute.repeats(rows, 200))
    assert got == want and any(r[2] for r in got)


def test_repeats_of_hot_anchors_and_shards(spark, rows):
    few = [(d, t[:1500]) for d, t in rows[:60]] + [(900 + i, f"{i * 7919} " + "a passage that all of them share, word for word, " * 2 + f"{i}") for i in range(12)]
    few += [(1000, "x" * 900), (1001, "x" * 130), (1002, None), (1003, "")]
    d = spark.createDataFrame(few, "doc_id long, text string")
    for width, hot, size in ((60, 2, 4000), (60, 10**6, 500), (200, 0, 10**6)):
        got = sorted(tuple(r) for r in suffix_dedup.removed(d, width, hot=hot, shard_bytes=size).collect())
        assert got == sorted(brute.repeats(few, width))


def test_repeats_keep_rows_and_columns(spark):
    d = odd(spark, [*TEXTS, "é" * 150 + "tail", "é" * 150 + "tale"])
    out = suffix_dedup.without_repeats(d).collect()
    assert len(out) == d.count() and list(out[0].asDict()) == d.columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    empty = suffix_dedup.removed(d.where("false"))
    assert empty.count() == 0


def test_simhash(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == brute.simhash_classes(rows)
    assert any(c != d for d, (_, c) in got.items())


def test_simhash_links_span_all_pairs(spark):
    import random

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(150)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for b in base * 3} | {base[0] ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute.components(signed, [(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4])
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for tile in (10**6, 20):
        root = {r.node: r.root for r in components.components(simhash.links(frame, 4, tile)).collect()}
        assert {s: root.get(s, s) for s in signed} == want
    for n in (1, 10**8, 10**12):  # finer blocks find the same
        edges, keys = simhash._layout(n, 4)
        assert all(any(all(((x >> edges[b]) & ((1 << (edges[b + 1] - edges[b])) - 1)) == 0 for b in k) for k in keys) for x in (sum(1 << rnd.randrange(64) for _ in range(4)) for _ in range(300)))


def test_simhash_odd_rows(spark):
    got = simhash.classes(odd(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    blank = [r for r in got if r.fp == 0]
    assert len(blank) == 3 and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert simhash.classes(odd(spark, TEXTS).where("false")).count() == 0


def test_near_copies_by_shingles(spark):
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(300)] for _ in range(40)]
    near = [[word() if i in (50, 200) else w for i, w in enumerate(t)] for t in texts[:20]]  # similarity 0.93
    far = [[word() if i % 12 == 0 else w for i, w in enumerate(t)] for t in texts[20:]]  # 0.4
    d = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(texts + near + far)], "doc_id long, text string, root int")
    for tile in (8192, 3):
        root = {r.doc_id: r.component_id for r in simhash.similar_classes(d, tile=tile).collect()}
        assert root == {i: i - 40 if 40 <= i < 60 else i for i in range(80)}
    assert sorted(r.doc_id for r in simhash.one_of_each(d).collect()) == [i for i in range(80) if not 40 <= i < 60]


def test_packing(spark, rows):
    path = catalog.tokenizer("word_bpe_49k.json")
    got = catalog.QUERIES["op4_packing"](spark, SF).collect()
    ids = dict(zip([d for d, _ in rows], brute.whole_ids([t for _, t in rows], path), strict=True))
    assert brute.packed_right(rows, got, ids) < 0.01


def test_packing_odd_rows(spark):
    path = catalog.tokenizer("word_bpe_49k.json")
    texts = [*TEXTS, "don't stop!! ... a,b c.d; (e) Ünder ÑANDÚ 12x34 µ º", "a\xa0b\x85c d", "é é", "x" * 5000]
    d = odd(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(777)))
    ids = dict(zip([r.doc_id for r in d.collect()], brute.whole_ids(texts, path), strict=True))
    assert brute.packed_right(None, packing.pack(d, path).collect(), ids) < 0.05
    assert packing.pack(d.where("false"), path).count() == 0
    assert packing.pieces(2048 * 2 + 1024 + 70) == [(0, 2048), (2048, 2048), (4096, 1024), (5120, 64), (5184, 6)]


def test_language(spark, documents):
    got = {r.doc_id: r for r in catalog.QUERIES["op10_language"](spark, SF).collect()}
    held = [r for r in documents.collect() if brute.crc(r.doc_id) % 3 == 1]
    assert all(got[d].held_out == (brute.crc(d) % 3 == 1) for d in got)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    d = odd(spark, [*TEXTS, "1234 5678"])
    out = {r.doc_id: r for r in lang_id.identify(d).collect()}
    assert len(out) == d.count() and out[3].lang_pred == out[1].lang_pred == out[11].lang_pred == "und" and out[0].lang_pred == "en"
    assert lang_id.identify(d.where("false")).count() == 0
    assert {r.lang_pred for r in lang_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.confident(d).columns == d.columns


def test_language_does_not_depend_on_neighbours():
    alone = lang_id.grams(["Été à"])[0]
    both = lang_id.grams(["zz", "Été à", "q"])
    a, b = both[1][1], both[1][2]
    assert (both[0][:, a:b] == alone).all()


def test_toxicity(spark, documents):
    got = {r.doc_id: r for r in catalog.QUERIES["op8_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[d].held_out == (brute.crc(d) % 4 == 2) for d in got)
    seen = [d for d in labels if not got[d].held_out]
    one, zero = ([got[d].score for d in seen if labels[d] == y] for y in (1, 0))
    assert sum(a > b for a in one for b in zero) / (len(one) * len(zero)) > 0.8


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 0), (1, 1), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxic(odd(spark, TEXTS), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.toxic(odd(spark, TEXTS), labels.where("false")).collect()} == {0.5}
    assert toxicity.toxic(odd(spark, TEXTS).where("false"), labels).count() == 0
