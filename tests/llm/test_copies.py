"""Exact copies of many lines leave one document in the pipeline."""

import random

import corpus_pipeline


def test_copies_of_many_lines(spark, tmp_path):
    rng = random.Random(0)
    say = lambda: " ".join(f"w{rng.randrange(2000)}" for _ in range(9))
    text = "\n".join(say() for _ in range(12))
    rows = [(i, "\n".join(say() for _ in range(6))) for i in range(20)] + [(100 + i, text) for i in range(6)] + [(200, "one line"), (201, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.ngram_jaccard_stage):
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == [*range(20), 100, 200, 201]
    assert {r.doc_id: r.text for r in docs.collect()}[100] == text
