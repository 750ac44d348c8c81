"""Columns of any name, texts without letters, many languages, mixed lengths, long texts, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import common, language_id, line_dedup, ngram_join, packing, secret_scan, substring_dedup, token_counts, vector_search
from tests.llm.test_pairs import brute_lines, brute_windows

INSIDE = ["_row", "_ROW_", "_gone", "_lines", "_from", "_past", "_at", "doc", "whole", "node", "class", "row", "spans", "_N_LINES"]


def crowded(spark, rows):
    """rows of (doc_id, text) and a column of each name used inside."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return frame.select("*", *[F.concat(F.lit(name), F.lit("!")).alias(name) for name in INSIDE])


def lines(rng, n):
    return [f"line {rng.randrange(10**6)} of {rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("dedup", [line_dedup.dedup, line_dedup.dedup_runs])
def test_line_dedup_carries_any_column(spark, dedup):
    text = "\n".join(lines(random.Random(0), 60))
    got = dedup(crowded(spark, [(1, text), (2, "own line\n" + text), (3, None)]))
    assert got.columns == ["doc_id", "text", *INSIDE[:-1], "_n_lines", "_n_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == text and rows[2]._n_removed > 0 and rows[3].text is None
    assert all(r[name] == f"{name}!" for r in rows.values() for name in INSIDE[:-1])


def test_ngram_join_trusts_no_column(spark):
    rows = [(i, " ".join(f"w{random.Random(i).random()}" for _ in range(20))) for i in range(6)]
    got = ngram_join.near_duplicates(crowded(spark, [*rows, (9, rows[2][1])])).collect()
    assert {r.doc_id: r.class_id for r in got} == {**{i: i for i in range(6)}, 9: 2}
    with pytest.raises(ValueError):
        common.numbered(crowded(spark, rows))


def test_stages_carry_any_column(spark, tmp_path):
    rng = random.Random(1)
    copy = "\n".join(lines(rng, 9))
    rows = [(i, "\n".join(lines(rng, 6))) for i in range(8)] + [(20, copy), (21, copy), (22, None), (23, "")]
    spark.createDataFrame([(1, "benchmark words " * 9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = crowded(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    names = docs.columns
    empty = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs, empty = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert docs.columns == names and empty.columns == names and empty.count() == 0, name
        assert all(r[c] == f"{c}!" for r in docs.collect() for c in INSIDE), name
    assert sorted(r.doc_id for r in docs.collect()) == [*range(8), 20]
    assert corpus_pipeline.pack_stage(spark, docs, str(tmp_path)).count() == 9


def test_language_stage_drops_what_no_language_fits(spark):
    rng = random.Random(2)
    words = {"aa": "the of and to in is that was for", "bb": "der die und das ist nicht ein zu", "cc": "le la les des est pour une dans", "dd": "el los que por con las del una"}
    say = lambda lang, n: [rng.choice(words[lang].split()) for _ in range(n)]
    rows = [(i, " ".join(say(lang, 60)), lang) for i in range(240) for lang in [list(words)[i % 4]]]
    mixed = " ".join(w for _ in range(40) for lang in words for w in say(lang, 6))
    rows += [(900, mixed, None), (901, "to", None), (902, "1234 5678", None), (903, None, None), (904, "½ ² ① Ⅷ ౩", None)]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    kept = {r.doc_id for r in corpus_pipeline.language_id_stage(spark, docs, "").collect()}
    assert kept == {*range(240), 901}


def test_no_letter_is_no_language(spark):
    assert [language_id.has_letter(t) for t in (None, "", "½ ² ①", "12 _", "x", "语", "é")] == [False] * 4 + [True] * 3
    rows = [(i, "some words here and there", "en") for i in range(20)] + [(50, "½ ² ①", "en")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 50").first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_every_language_is_sampled(spark):
    rows = [(i, f"text {i} of {i % 90}", f"l{i % 90:02}") for i in range(900)] + [(5000, "hot row", "l00")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = Counter(lang for _, lang in language_id.training_sample(docs, F.lit(True), 500, 64, 450))
    assert set(held) == {f"l{k:02}" for k in range(90)} and max(held.values()) <= 5


def nearest(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    held: dict = {}
    for r in vector_search.nearest(frame, F.col("id") % 20 == 0, **options).collect():
        held.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(x)] for q, x in held.items()}


def test_each_length_is_a_space(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6 if i % 3 else 9).tolist()) for i in range(300)]
    got = nearest(spark, rows)
    for q, found in got.items():
        same = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        own = np.array(rows[q][1], dtype=np.float32).astype(float)
        cosine = [v @ own / np.linalg.norm(v) for _, v in same]
        assert found[0] == same[int(np.argmax(cosine))][0] and all(len(rows[i][1]) == len(own) for i in found)
    assert len(got) == 15


def test_buckets_of_several_axes_and_hot_cells(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 16))
    x = (centers[np.arange(3000) % 60] + 0.1 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:2000] = x[7]  # a vector that a third of all rows share
    got = nearest(spark, [(i, v.tolist()) for i, v in enumerate(x)], group_rows=64, group_queries=16)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 20):
        score = np.round(unit @ unit[q], 9)
        score[q] = -2
        hits += len(set(np.lexsort((np.arange(3000), -score))[:5].tolist()) & set(got[q]))
    assert len(got) == 150 and hits / 750 >= 0.9
    assert got[1000] == [7, 1001, 1002, 1003, 1004]


def test_blocks_of_spans(spark, tmp_path):
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(5000) < 0.02, 9, 1).astype("<u2")
    ids.tofile(tmp_path / "a.bin")
    want = [(int(b - a - 1)) for a, b in zip(np.append(-1, np.flatnonzero(ids == 9)), np.append(np.flatnonzero(ids == 9), 5000), strict=False)]
    for span in (1, 3, 1000):
        rows = token_counts.count_tokens(spark, f"file://{tmp_path}", separator=9, block_tokens=37, span_blocks=span).orderBy("doc_number").collect()
        assert [r.n_tokens for r in rows if r.terminated] == want[: int((ids == 9).sum())]
        assert [r.doc_number for r in rows] == list(range(len(rows)))


def test_ids_too_large_for_the_width(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_token_files(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), f"file://{tmp_path}/t", separator=70_000)


def test_long_texts(spark):
    rng = random.Random(3)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(900)]
    long = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    long[500:500], long[20_000:20_000] = passage, passage[100:800]
    rows = [(1, " ".join(long)), (2, " ".join(passage[200:700])), (3, "x " * 20_000)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_windows(rows, 35)
    block = lines(rng, 20_000)
    rows = [(1, "\n".join(block)), (2, "\n".join(block[5000:] + lines(rng, 50)))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_removed) for r in got) == brute_lines(rows, 3, 2)


def test_each_capacity_of_the_pipeline_changes_a_packing(spark, tmp_path):
    rng = random.Random(4)
    sizes = [2048] * 40 + [rng.randrange(1, 900) for _ in range(300)] + [1 + rng.randrange(20) for _ in range(3000)]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").write.parquet(str(tmp_path / "pieces"))
    made = lambda *limits: packing.pack(spark.read.parquet(str(tmp_path / "pieces")), *limits, weights=(1.0, 0.2, 0.2)).select("sequence_id").distinct().count()
    tokens, count, cost = corpus_pipeline.SEQUENCE, corpus_pipeline.DOCUMENTS, corpus_pipeline.COST
    whole = made(tokens, count, cost)
    assert made(tokens, 10**6, cost) < whole and made(tokens, count, tokens**2) <= whole
    assert made(tokens, 10**6, tokens**2) < made(tokens, 10**6, cost) and made(tokens * 8, count, cost) <= whole


def test_secrets_of_held_out_words(spark):
    rng = random.Random(5)
    syllables = "ba co di fe gu la mo ni pe ra so tu ve wi yo the ing er an on".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choice(letters + "0123456789" * (k % 2)) for _ in range(16 + k % 5 * 4)) for k in range(200)]
    plain = ["".join(x if not i else x.capitalize() for i, x in enumerate(word() for _ in range(4))) for _ in range(200)]
    plain = [x for x in plain if len(x) >= 16]
    rows = [(i, " ".join(word() for _ in range(40))) for i in range(300)] + [(1000 + i, f"see {k} there") for i, k in enumerate(keys)] + [(2000 + i, f"see {k} there") for i, k in enumerate(plain)]
    got = {r.doc_id: r.n for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", F.size("random").alias("n")).collect()}
    assert sum(got[1000 + i] for i in range(len(keys))) >= 0.9 * len(keys)
    assert sum(got[2000 + i] for i in range(len(plain))) <= 0.05 * len(plain)
