"""The pipeline's stages take effect and keep clean documents."""

import random

import corpus_pipeline
from palimpsest.llm import registry


def test_pipeline(spark, tmp_path):
    rng = random.Random(0)
    langs = {"en": "the of and to in is that was", "de": "der die und das ist nicht ein zu"}
    say = lambda lang, n: " ".join(rng.choice(langs[lang].split()) + str(rng.randrange(40)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(20))
    block = "\n".join(f"footer line {i}" for i in range(12))
    rows = [(i, say(lang, 120), lang) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    rows += [(100, rows[0][1], "en"), (101, "1234 5678", "en"), (102, None, None), (103, item, "en"), (104, rows[1][1] + "\n" + block, "de"), (105, rows[2][1][::-1] + "\n" + block, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    first = set(range(60))
    assert seen[0] >= first and not seen[0] & {101, 102}
    assert seen[1] == seen[0]
    assert 100 not in seen[2] and seen[2] >= first
    assert 103 in seen[2] and 103 not in seen[3] and seen[3] >= first and seen[4] == seen[3]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).columns) == 7


def test_names():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.oracle_sql()) <= set(registry.queries())
