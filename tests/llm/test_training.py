"""The language model learns from every token of every training document."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import lm_score


class Recorder:
    """An optimizer that keeps the gradients and leaves the parameters alone."""

    def __init__(self):
        self.seen = []

    def step(self, grads):
        self.seen.append(grads["bc"].astype(np.float64))


def model(rng):
    h = np.arange(20, dtype=np.int64)
    v = lm_score.Vocabulary(np.append(h, lm_score.END), np.append(100 - h, 10), int((100 - h).sum()) + 10, 21, 12, 4)
    p = lm_score.new_model(v, 6)
    p["wc"], p["wo"] = rng.normal(size=p["wc"].shape).astype(np.float32), rng.normal(size=p["wo"].shape).astype(np.float32)
    return p, v


def test_every_token_with_the_state_carried():
    rng = np.random.default_rng(3)
    p, v = model(rng)
    doc = v.entries(np.append(rng.integers(0, 25, 999), lm_score.END))
    whole, cut = Recorder(), Recorder()
    assert lm_score.train_on(p, v, [doc], whole, steps=1000, lanes=1) == 1000
    assert lm_score.train_on(p, v, [doc], cut, steps=7, lanes=1) == 1000
    sizes = [7] * 142 + [6]
    assert len(whole.seen) == 1 and len(cut.seen) == len(sizes)
    assert np.allclose(whole.seen[0] * 1000, sum(n * g for n, g in zip(sizes, cut.seen, strict=True)), atol=1e-2)


def test_lanes_of_unequal_length():
    rng = np.random.default_rng(4)
    p, v = model(rng)
    docs = [v.entries(np.append(rng.integers(0, 25, n), lm_score.END)) for n in (0, 3000, 1, 40, 700, 64, 5)]
    assert lm_score.train_on(p, v, docs, Recorder(), steps=5, lanes=3) == sum(map(len, docs))


def test_rounds_learn_from_all_documents(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 3000)))) for i in range(120)]
    seen = []
    kept = lm_score.train_round
    monkeypatch.setattr(lm_score, "train_round", lambda *a, **b: seen.append(kept(*a, **b)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    total = {r.train_tokens for r in lm_score.score(docs, vocabulary_size=32, classes=6, size=8).collect()}
    # the rows that a round leaves hold the tokens learned from, once for each part
    learned = sum(t.where("part = 0").agg(F.sum("weight")).first()[0] for t in seen)
    want = sum(len(t.split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    assert total == {want} and learned == want and len(seen) == 2
