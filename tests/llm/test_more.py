"""Vectors, MinHash, token counts, pieces, secrets and the pipeline, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatherline.llm import catalog, minhash, pieces, secrets, simhash, vector_dedup, word_counts

from . import brute
from .test_dealt import SF, TEXTS, odd

MODEL = catalog.tokenizer("piece_bpe_32k.model")
WORDS = catalog.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def plain_links(rows, threshold):
    good = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = [(a, b) for k, (a, u, y) in enumerate(good) for b, w, z in good[k + 1 :] if y == z and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= threshold]
    root = brute.components([i for i, _, _ in rows if i is not None], links)
    n = {i: 0 for i in root}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], root[i], root[i] == i) for i in root)


def test_vectors(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES["op9_vectors"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == plain_links(rows, 0.93)
    sims = np.array([r[1] for r in rows], float)
    sims = sims / np.linalg.norm(sims, axis=1, keepdims=True)
    low = float(np.quantile(sims @ sims.T, 0.97)) + 1e-6  # so that there are links
    want = plain_links(rows, low)
    assert sorted(tuple(r) for r in vector_dedup.linked(spark.read.parquet(f"{SF}/embeddings.parquet"), low, 100).collect()) == want
    assert any(r[1] for r in want)


def test_vectors_odd_rows_and_small_tiles(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 6)).astype(np.float32)
    near = [(b + rng.normal(size=6) * 0.12).astype(np.float32) for b in base for _ in range(6)]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([*base, *near])]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 6, 1), (303, [1.0, None, 0, 0, 0, 0], 1), (304, [float("nan")] * 6, 1), (305, [float("inf"), 1.0, 0, 0, 0, 0], 1), (306, rows[0][1], None), (307, rows[0][1][:4], 0), (308, rows[0][1][:4], 0)]
    rows = [(a, v and [x if x is None else float(x) for x in v], y) for a, v, y in rows]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, low double")
    for tile in (2048, 5):
        got = sorted(tuple(r) for r in vector_dedup.linked(d, 0.93, tile).collect())
        assert got == plain_links(rows, 0.93)
    lost = vector_dedup.linked(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in lost] == [(None, 0, None, False)] * 2
    assert vector_dedup.linked(d.where("false")).count() == 0


def plain_next(texts):
    ids = sorted(texts)
    return {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("slots", [None, 1, 37])
def test_fingerprints(spark, documents, texts, slots):
    got = {r.doc_id: r for r in minhash.fingerprints(documents, slots).collect()}
    follow = plain_next(texts)
    assert set(got) == set(texts)
    by_text, off = {}, []
    for d, r in got.items():
        t, f = texts[d], texts[follow[d]]
        q = len(t) // 4
        new = t[: len(t) - q] + f[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_next == sum(r.fingerprint[i : i + 4] == got[follow[d]].fingerprint[i : i + 4] for i in range(0, 512, 4)) / 128
        a, b = shingle_set(t), shingle_set(new)
        off.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2


def test_fingerprints_odd_rows(spark):
    d = odd(spark, [*TEXTS, "a b", "a b"])
    assert minhash.fingerprints(d).count() == d.count()
    one = minhash.fingerprints(d.limit(1)).first()
    assert one.near_next == 1.0
    assert minhash.fingerprints(d.where("false")).count() == 0


def test_near_duplicates_by_minhash(spark, texts):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    whole = [[word() for _ in range(200)] for _ in range(30)]
    near = [[word() if i == 60 else w for i, w in enumerate(t)] for t in whole[:15]]
    rows = list(enumerate([" ".join(t) for t in whole + near] + ["", " ", None]))
    d = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    sets = {i: shingle_set(t or "") for i, t in rows}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    want = brute.components(sets, [(i, j) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.8])
    for tile in (8192, 2):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d, tile=tile).collect()} == want


def plain_greedy(word, vocab):
    n, at = 0, 0
    while at < len(word):
        k = next((k for k in range(len(word), at, -1) if word[at:k] in vocab), None)
        if k is None:
            return -1
        n, at = n + 1, k
    return n


def test_token_counts(spark, texts):
    vocab = set(word_counts.pieces_of(MODEL))
    for r in catalog.QUERIES["op7_token_counts"](spark, SF).collect():
        c = [plain_greedy("▁" + w, vocab) for w in texts[r.doc_id].split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(c), sum(map(abs, c)), sum(x < 0 for x in c))


def test_automaton_on_small_vocabularies():
    rnd = random.Random(1)
    for _ in range(300):
        vocab = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(6)}
        a = word_counts.Automaton(vocab)
        for _ in range(20):
            w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
            assert a.count(w) == plain_greedy(w, vocab)


def test_token_counts_odd_rows(spark):
    d = odd(spark, [*TEXTS, "\U0001f600\U0001f601"])
    got = word_counts.token_counts(d, MODEL).collect()
    assert len(got) == d.count() and [tuple(r) for r in got if r.doc_id == 3] == [(3, 0, 0, 0)]
    assert word_counts.token_counts(d.where("false"), MODEL).count() == 0


def test_pieces_best_score():
    m = pieces.Pieces(MODEL)

    def best(word):
        top = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max([top[e - 1] + m.unknown] + [top[s] + m.score[word[s:e]][0] for s in range(e) if word[s:e] in m.score])
        return top[-1]

    back = {i: p for p, (_, i) in m.score.items()}
    words = sorted({"▁" + w for t in TEXTS if t for w in t.split()} | {"▁▁▁the", "▁thndhain", "▁thndha", "▁", "▁日x", "▁Ünglück"})
    for w, ids in zip(words, m.segment(words), strict=True):
        spelt = b"".join(m.text[i] for i in ids).decode()
        assert spelt.replace(" ", "▁") == w
        n_bytes = sum(len(ch.encode()) for ch in w if ch not in m.score) if any(i in m.byte.values() for i in ids) else 0
        total = sum(m.score[back[i]][0] for i in ids if i in back) + m.unknown * (sum(ch not in m.score for ch in w) if n_bytes else 0)
        assert abs(total - best(w)) < 1e-6


def test_pieces_like_the_library(texts):
    """The library mostly finds as good, and never better, segmentations once the model file says that scores are to be summed."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    lib = SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = pieces.Pieces(MODEL)
    score = lambda ids: sum(m.score[lib.id_to_piece(int(i))][0] for i in ids if lib.id_to_piece(int(i)) in m.score)
    words = sorted({w for t in texts.values() for w in t.split()})[:20000]
    checked = same = 0
    for w, ids in zip(words, m.encode(words), strict=True):
        if score(ids) > -1e8 and not set(ids.tolist()) & set(m.byte.values()):  # the library sums in single precision
            other = score(lib.encode(w))
            assert score(ids) > other - 1, w
            checked += 1
            same += abs(score(ids) - other) < 1
    assert checked > 1000 and same > 0.9 * checked


def test_pieces_round_trip(spark, texts):
    assert all(r.round_trip for r in catalog.QUERIES["op3_pieces"](spark, SF).collect())
    d = odd(spark, [*TEXTS, "a▁b c▁", "▁", "  two  spaces  ", "\u0000\U0001f600 é"])
    d = d.withColumn("doc_id", F.coalesce("doc_id", F.lit(500)))
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d, MODEL), MODEL).collect()}
    assert back == {r.doc_id: r.text for r in d.collect()}
    assert pieces.coded(d.where("false"), MODEL).count() == 0


def test_secrets(spark):
    rnd = random.Random(4)
    hex_ = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    upper = lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    bad = ["password=changeme", "token = your-token-1234567", "see https://example.com/a/b/c123456789012", "card 4041894974608795 here", "version 2024-01-02T10:11:12 of it", "password is required"]
    rows, planted = [], {}
    for i in range(300):
        s = [f"password={hex_(18)}", f'token = "{hex_(40)}"', upper()][i % 3]
        secret = s.split("=")[-1].strip(' "')
        rows.append((i, f"Of thndes inre {bad[i % 6]} and then {s} the aning edlyan."))
        planted[i] = secret
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = [r for r in secrets.scan(d, WORDS).collect() if r.is_secret]
    found = {(r.doc_id, text[r.doc_id][r.start : r.start + r.length]) for r in got}
    assert found == set(planted.items())
    clean = {r.doc_id: r.text for r in secrets.redact(d.withColumn("n_chars", F.lit(0)), WORDS).collect()}
    assert all(s not in clean[i] and "[SECRET]" in clean[i] and bad[i % 6] in clean[i] for i, s in planted.items())


def test_secrets_odd_rows(spark):
    d = odd(spark, [*TEXTS, "x" * 20000 + "1", "password=" + "ab12" * 5000])
    assert secrets.scan(d, WORDS).count() >= 2
    out = secrets.redact(d, WORDS)
    assert out.count() == d.count() and out.columns == d.columns
    assert secrets.scan(d.where("false"), WORDS).count() == 0
    labelled = spark.createDataFrame([([1.0] * len(secrets.FEATURES), None)], "features array<double>, label int")
    assert secrets.scan(d, WORDS, labelled).count() == secrets.scan(d, WORDS).count()


def test_secrets_held_out(spark):
    """A forest from half of the labelled findings agrees with the labels of the other half."""
    found = secrets.labelled_findings(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORDS).where("label is not null")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    trees = secrets.fit(found.where(half))
    rest = found.where(~half).collect()
    p = secrets.forest.predict(trees, np.array([r.features for r in rest]))
    assert np.mean((p > 0.5) == np.array([r.label for r in rest])) > 0.97


def test_pipeline_stages(spark, documents, texts):
    kept, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == documents.columns, name
        kept = spark.createDataFrame(out.collect(), documents.schema)
        seen.append({r.doc_id: r.text for r in kept.collect()})
    assert set(seen[0]) == set(texts)  # all have a known language
    root = {r.doc_id: r.component_id for r in simhash.similar_classes(documents).collect()}
    assert set(seen[1]) == {d for d in texts if root[d] == d} and len(seen[1]) < len(texts)
    cut = {d: n for d, _, n, _, _ in brute.repeats(sorted(seen[1].items()), 200)}
    assert set(seen[2]) == set(seen[1]) and all((seen[2][d] == seen[1][d]) == (cut[d] == 0) for d in cut)
    assert seen[3] == {d: t for d, t in seen[2].items()}  # these tables hold no secrets
    rows = sorted(seen[3].items())
    got = corpus_pipeline.run(spark, SF).collect()
    ids = dict(zip([d for d, _ in rows], brute.whole_ids([t for _, t in rows], WORDS), strict=True))
    assert brute.packed_right(rows, got, ids) < 0.01


def test_pipeline_masks_secrets(spark, documents):
    rnd = random.Random(8)
    rows = [(10**6 + i, f"A line with password={rnd.getrandbits(72):018x} in it.", "en", "s", 0) for i in range(20)]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    out = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, docs, SF).collect()}
    assert len(out) == documents.count() + 20
    assert all(out[d] == "A line with password=[SECRET] in it." for d, *_ in rows)


def test_near_copies_in_documents(spark, texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert pairs and all(root[a] == root[b] for a, b in pairs)
