"""Language ID, LM scores and vector search: accuracy, exact parts, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import gru, language_id, lm_score, vector_search

LANGS = {"aa": "the of and to in is that was for", "bb": "der die und das ist nicht ein zu", "cc": "le la les des est pour une dans"}


def text(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 3) for i, t, x in rows], "doc_id long, text string, lang string, doc string, row int").repartition(3)


def held(i, folds, fold):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold


def test_language_id(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.randrange(8, 60)), lang) for i in range(200) for lang in [rng.choice(list(LANGS))]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 ... 45", "bb"), (None, text(rng, "bb", 20), None), (5, rows[5][1], rows[5][2]), (903, text(rng, "cc", 9000), "cc")]
    got = language_id.identify(make(spark, rows + odd), keep=("doc", "row")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0) and r.doc == "s" and r.row == 3 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (900, 901, 902)} == {"und"} and by_id[None].lang_pred == "bb" and by_id[903].lang_pred == "cc"
    tested = [(by_id[i].lang_pred, lang) for i, _, lang in rows if held(i, 5, 0)]
    assert np.mean([a == b for a, b in tested]) > 0.95


def test_language_id_without_rows(spark):
    assert language_id.identify(make(spark, [])).count() == 0
    (row,) = language_id.identify(make(spark, [(1, "words here", None)])).collect()
    assert row.lang_pred == "und"


def test_every_byte_counts():
    p = language_id.new_model(3)
    texts = [b"a" * 300, b"", "żółw".encode(), b"x" * 128]
    total = language_id.byte_probabilities(p, texts, 128)
    assert np.allclose(total.sum(axis=1), [len(t) for t in texts], atol=1e-2)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    x, u, h = rng.normal(size=(5, 3, 8)), rng.normal(size=(4, 8)), np.zeros((3, 4), dtype=np.float32)
    keep = (rng.random((5, 3)) < 0.7).astype(np.float32)
    weight = rng.normal(size=(5, 3, 4))
    loss = lambda x, u: float((gru.forward(x.astype(np.float32), u, h, keep)[0] * weight).sum())
    _, _, saved = gru.forward(x.astype(np.float32), u, h, keep, store=True)
    dx, du = gru.backward(weight.astype(np.float32), u.astype(np.float32), saved, keep)
    for array, grad in ((x, dx), (u, du)):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-2
            up = loss(x, u)
            array[at] = old - 1e-2
            down = loss(x, u)
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [x.decode() for x in low.encode().split()] + [None]


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_lm_scores(spark, hot):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(pool[: 5 + 3 * k]) for k in range(rng.randrange(0, 90))), "x") for i in range(120)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "W1 w2 É é", "x"), (3, rows[3][1], "x"), (902, "w1 w2 " * 4000, "x")]
    got = lm_score.score(make(spark, rows), vocabulary_size=32, classes=6, size=8, hot_words=hot).collect()
    counts = Counter(w for i, t, _ in rows if not held(i, 7, 2) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, held(i, 7, 2), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_scores_without_rows(spark):
    assert lm_score.score(make(spark, []), vocabulary_size=16, classes=4, size=4).count() == 0


def test_lm_state_is_carried():
    rng = np.random.default_rng(3)
    h = np.arange(20, dtype=np.int64)
    v = lm_score.Vocabulary(np.append(h, lm_score.END), np.append(100 - h, 10), int((100 - h).sum()) + 10, 21, 12, 4)
    p = lm_score.new_model(v, 6)
    p["wc"], p["wo"] = rng.normal(size=p["wc"].shape).astype(np.float32), rng.normal(size=p["wo"].shape).astype(np.float32)
    docs = [v.entries(np.append(rng.integers(0, 25, n), lm_score.END)) for n in (0, 1, 200, 63, 64, 65, 7)]
    whole = lm_score.score_batch(p, v, docs, steps=1000)
    assert np.allclose(whole, lm_score.score_batch(p, v, docs, steps=3, lanes=2), rtol=1e-4)
    assert np.allclose(whole, [lm_score.score_batch(p, v, [d])[0] for d in docs], rtol=1e-4)
    states = rng.normal(size=(1, 6)).astype(np.float32).repeat(len(v.h), axis=0)
    assert np.exp(lm_score.log_probs(p, v, states, np.arange(len(v.h)))).sum() == pytest.approx(1, abs=1e-4)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, row int").repartition(4)


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[50].tolist()) for i in range(40)]  # ties
    rows += [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, [1.0] * 23 + [None]), (2200, [1.0] * 5), (2250, [float("inf")] * 24), (None, x[3].tolist())]
    got = vector_search.nearest(vectors(spark, rows), F.col("id") % 50 == 0, block=7).collect()
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    ids = [i for i, _ in good]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hits = total = 0
    for k, (i, _) in enumerate(good):
        if i is None or i % 50:
            continue
        score = np.round(unit @ unit[k], 12)
        order = sorted((j for j in range(len(good)) if j != k), key=lambda j: (-score[j], ids[j] is None, ids[j] or 0))[:5]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(unit[k] @ unit[ids.index(r.id)], abs=1e-9) for r in mine)
        hits += len({ids[j] for j in order} & {r.id for r in mine})
        total += 5
        if i == 50:
            assert [r.id for r in mine] == [1000, 1001, 1002, 1003, 1004]
    assert hits / total >= 0.9


def test_vector_search_few(spark):
    assert vector_search.nearest(vectors(spark, []), F.col("id") % 50 == 0).count() == 0
    got = vector_search.nearest(vectors(spark, [(0, [1.0, 0.0, 0.0]), (50, [1.0, 1.0, 0.0]), (7, [0.0, 0.0, 2.0])]), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.id) for r in sorted(got)] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = vector_search.hadamard(x)
    assert np.allclose(vector_search.hadamard(y), x) and np.allclose((y**2).sum(axis=1), (x**2).sum(axis=1))


def test_byte_probabilities_of_texts_of_unlike_lengths():
    """Texts run side by side give what each gives alone, by a plain loop."""
    params = language_id.new_model(3)
    texts = [b"abc", "é".encode() * 9, b"", b"\x00q", b"abcdefgh" * 5]
    got = language_id.byte_probabilities(params, texts, 16)
    for data, row in zip(texts, got):
        want = np.zeros(3)
        for k in range(0, len(data), 16):
            part = data[k : k + 16]
            states = {}
            for d, run in (("l", part), ("r", part[::-1])):
                h, seen = np.zeros(language_id.SIZE), []
                for byte in run:
                    a = params[f"x{d}"][byte] + h @ params[f"u{d}"]
                    z = 1 / (1 + np.exp(-a[: language_id.SIZE]))
                    h = h + z * (np.tanh(a[language_id.SIZE :]) - h)
                    seen.append(h)
                states[d] = seen if d == "l" else seen[::-1]
            for left, right in zip(states["l"], states["r"]):
                e = np.exp(left @ params["ol"] + right @ params["or"] + params["b"])
                want += e / e.sum()
        assert np.allclose(row, want, atol=1e-3)
