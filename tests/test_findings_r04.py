"""What the review of round 4 found, each against a plain version."""

import numpy as np
import pytest

from gatherline.llm import secrets, simhash, suffix_dedup
from gatherline.operators import hmm


def _prints(rng, n):
    f = rng.integers(0, 1 << 63, (n, simhash.WIDE), dtype=np.uint64) << np.uint64(1)
    f[1::4] = f[::4] ^ (rng.integers(0, 1 << 63, f[::4].shape, dtype=np.uint64) & rng.integers(0, 1 << 63, f[::4].shape, dtype=np.uint64))  # a quarter of the bits differ
    f[-1] = ~f[-2]
    return f


@pytest.mark.parametrize("most", [0, 134, 300])
def test_f1_unlike_fingerprints_are_ruled_out_by_the_sieve(most):
    f = _prints(np.random.default_rng(4), 400)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2, dtype=int)
    i, j = simhash._close(f[:100].T, f.T, most)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(d[:100] <= most))))
    if most == 134:
        assert len(simhash._sieved(f.T, f.T, most)[0]) < 0.02 * d.size


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 700])
def test_f1_bits_of_wide_fingerprints(n):
    s = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    bits = [sum(int(x) >> b & 1 for x in simhash.mix(s + np.uint64(w))) * 2 > n for w in range(simhash.WIDE) for b in range(64)]
    got = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(s, 300), np.uint8), bitorder="little")
    assert got.astype(bool).tolist() == bits


@pytest.mark.parametrize("width", [40, 57])
def test_f1_only_contexts_that_may_repeat_reach_a_suffix_array(width):
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, 7, dtype=np.uint8)) + b" " for _ in range(40)]
    texts = [b"".join(words[i] for i in rng.integers(0, 40, 400)) + b"same old phrase, same place. " + b"".join(words[i] for i in rng.integers(0, 40, 400)) for _ in range(12)]
    texts += [texts[0][500:1700] + texts[1], b"ab" * 300]
    seen, rows = {}, []
    for number, start, n, anchor, context in suffix_dedup.segments(texts, width):
        for i, at, k, a, c in zip(number.tolist(), start.tolist(), n.tolist(), anchor.tolist(), context.tolist()):
            rows.append((a, c, texts[i][at : at + k + width - 1]))
            seen.setdefault(rows[-1][:2], rows[-1][2])
    keys = sorted(seen)
    anchors, parts = np.array([k[0] for k in keys], np.uint64).view(np.int64), [seen[k] for k in keys]
    may = suffix_dedup._may_share(parts, anchors, width)
    where = {}
    for i, p in enumerate(parts):
        for at in range(len(p) - width + 1):
            where.setdefault(p[at : at + width], set()).add(i)
    must = {i for v in where.values() if len(v) > 1 for i in v}
    assert must and must <= set(np.flatnonzero(may).tolist())
    several = sum(n > 1 for n in np.unique(anchors, return_counts=True)[1][np.unique(anchors, return_inverse=True)[1]].tolist())
    assert may.sum() < several / 2


@pytest.mark.parametrize("text", ["x \u017fecret_key: Zx81kd02mq", "ap\u0130key = Zx81kd02mq", "cred\u0131ent\u0131al=Zx81kd02mq", "TO\u212aEN: Zx81kd02mq", "no such name: Zx81kd02mq", "MyPASSWORD is Zx81kd02mq"])
def test_f1_no_name_is_passed_over(text, monkeypatch):
    from gatherline.llm.catalog import tokenizer

    words = secrets.dictionary(tokenizer("word_bpe_49k.json"))
    got = secrets.candidates(text, words)
    monkeypatch.setattr(secrets, "_HINTS", ("",))
    assert got == secrets.candidates(text, words)


@pytest.fixture
def large(monkeypatch):
    """Small tables take the way of large ones; gives the numbers of models of each pass."""
    monkeypatch.setattr(hmm, "ROWS_IN_A_TASK", 100)
    monkeypatch.setattr(hmm, "BEGIN_ROWS", 200)
    passes, plain = [], hmm._pass
    monkeypatch.setattr(hmm, "_pass", lambda table, keys, models, *rest: passes.append(len(models)) or plain(table, keys, models, *rest))
    return passes


def _sequences(spark, n=20, rows=50):
    rng = np.random.default_rng(11)
    data = [(g, t, float(rng.normal(3 * ((t // 5 + g) % 2), 1)), rows * g + t) for g in range(n) for t in range(rows)]
    return spark.createDataFrame(data, "g int, t int, x double, id int")


def test_f4_large_fits_reach_the_maximum_in_fewer_passes(spark, large):
    packed = hmm.packed(_sequences(spark), ["g"], ["t"], ["x"])
    (m,) = hmm.fit_packed(hmm.settle(packed.repartition(3)), ["g"], [hmm.Model(2, 1)], 1)
    assert m.converged and m.rounds == len(large) and set(large) == {1} and len(large) < 30
    assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:])) and m.occupancy.sum() == pytest.approx(1000) and m.trans.sum(1) == pytest.approx(np.ones(2))
    (old,) = hmm.fit_packed(hmm.settle(packed.coalesce(1)), ["g"], [hmm.Model(2, 1)], 1)  # in one task, as small tables are
    assert len(large) == m.rounds and m.loglik == pytest.approx(old.loglik, abs=1e-3) and m.means == pytest.approx(old.means, abs=1e-2)


def test_f4_models_that_start_alike_climb_once(spark, large):
    best = hmm.choose(_sequences(spark), ["g"], ["t"], ["x"], ks=(2,), seeds=(1, 2, 3))
    assert set(large) == {1} and best[0].n_rows == 1000 and np.isfinite(best[0].bic)
