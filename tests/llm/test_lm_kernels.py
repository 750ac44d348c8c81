"""The language model's lookups, output layer and gradients against plain ones."""

import pickle
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import lm_score


def vocabulary(rng, size=60, classes=5):
    h = np.unique(rng.integers(-(2**63), 2**63 - 1, 500))
    c = rng.integers(1, 1000, len(h))
    return lm_score.Vocabulary(np.append(h, lm_score.END), np.append(c, 90), int(c.sum()) + 100, len(h) + 9, size, classes)


@pytest.mark.parametrize("crowded", [False, True])
def test_places(crowded):
    rng = np.random.default_rng(0)
    draw = lambda n: rng.integers(0, 3000, n) if crowded else rng.integers(-(2**63), 2**63 - 1, n)
    keys = np.unique(draw(1000))
    h = np.concatenate([keys, draw(1000), [-(2**63), -1, 0, 2**63 - 1]])
    assert (lm_score.Places(keys).of(h) == np.searchsorted(keys, h)).all()


def test_counts_of_tokens():
    rng = np.random.default_rng(1)
    v = vocabulary(rng)
    v.entries(v.h)
    v = pickle.loads(pickle.dumps(v))
    h = np.concatenate([v.hot_h, rng.integers(-(2**63), 2**63 - 1, 300)])
    hot, own = dict(zip(v.hot_h.tolist(), v.hot_c.tolist(), strict=True)), {k: i for i, k in enumerate(v.h.tolist())}
    entry = v.entries(h)
    assert entry.tolist() == [own.get(k, v.rest) for k in h.tolist()]
    assert v.counts(h, entry).tolist() == [hot.get(k, -1) for k in h.tolist()]


@pytest.mark.parametrize("scale", [1, 40])
def test_log_probs_and_gradients(scale):
    rng = np.random.default_rng(2)
    v = vocabulary(rng)
    p = lm_score.new_model(v, 8)
    p["wc"], p["wo"] = (scale * rng.normal(size=p[k].shape).astype(np.float32) for k in ("wc", "wo"))
    s, target = np.tanh(rng.normal(size=(400, 8))).astype(np.float32), rng.integers(0, len(v.h), 400)
    got, g, back = lm_score.log_probs(p, v, s, target, grads=True, block=64)
    assert (got == lm_score.log_probs(p, v, s, target, block=64)).all()
    want, came = [], []
    sums = {k: np.zeros(p[k].shape) for k in g}
    for h, t in zip(s.astype(float), target, strict=True):
        c = v.class_of[t]
        lo, hi = v.bounds[c], v.bounds[c + 1]
        a, b = h @ p["wc"] + p["bc"], p["wo"][lo:hi] @ h + p["bo"][lo:hi]
        a, b = a - a.max() - np.log(np.exp(a - a.max()).sum()), b - b.max() - np.log(np.exp(b - b.max()).sum())
        want.append(a[c] + b[t - lo])
        da, db = np.exp(a), np.exp(b)
        da[c] -= 1
        db[t - lo] -= 1
        sums["wc"] += np.outer(h, da) / 400
        sums["bc"] += da / 400
        sums["wo"][lo:hi] += np.outer(db, h) / 400
        sums["bo"][lo:hi] += db / 400
        came.append((p["wc"] @ da + db @ p["wo"][lo:hi]) / 400)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and np.allclose(back, came, atol=1e-5 * scale)
    assert all(np.allclose(g[k], sums[k], atol=1e-5) for k in g)


def test_input_gradient():
    rng = np.random.default_rng(3)
    v = vocabulary(rng)
    entry, d = rng.integers(0, len(v.h), 1000), rng.normal(size=(1000, 8)).astype(np.float32)
    want = np.zeros((len(v.h), 8))
    np.add.at(want, entry, d)
    assert np.allclose(lm_score.input_gradient(v, entry, d[:, :4], d[:, 4:], block=64), want, atol=1e-4)


@pytest.mark.parametrize("bound", [5, 60, 10_000])
def test_counts_of_words(spark, bound):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 300), i % 4 > 0) for i in range(200)] + [(200, None, True), (201, "W1", False)]
    docs = spark.createDataFrame(rows, "row long, text string, train boolean").repartition(3)
    got = {r.h: r.c for r in lm_score.count_words(docs, bound).collect()}
    want = Counter(h for _, t, train in rows if train for h in lm_score._tokens([(t or "").encode()])[0].tolist())
    assert got == want


def test_summed():
    h, c = lm_score.summed([(np.array([1, 5]), np.array([2, 1])), (np.array([-3, 5, 9]), np.array([1, 4, 7]))])
    assert h.tolist() == [-3, 1, 5, 9] and c.tolist() == [1, 2, 5, 7]


def test_documents_of_batches_go_side_by_side():
    docs = [[np.zeros(n, dtype=np.int32)] for n in (3, 4, 5, 100, 1, 2)]
    groups = list(lm_score.side_by_side(iter([(d, i) for i, d in enumerate(docs)]), tokens=10))
    assert [[i for _, i in g] for g in groups] == [[0, 1, 2], [3], [4, 5]]
