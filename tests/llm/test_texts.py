"""Packing, decontamination, token counts, secrets against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import common, decontam, packing, registry, secret_scan, token_counts, tokens

SCHEMA = "doc_id long, text string, row long, items string, start int"


def make(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_files()[0])


ODD = ["", "plain words here", "naïve café — “quoted” …", "日本語のテキスト", "tab\tand\nline  ", "x" * 5000, "<|endoftext|> inside", "🙂🙂 emoji", "１２３ ²³", "don't WON'T  '   s", " nbsp em"]


def test_encoder_agrees(exact):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abc é'1 \n.…—ñß") for _ in range(200)) for _ in range(50)]
    found = tokens.Encoder(*tokens.vocabulary_files()).ids(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_pack(spark, exact):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma9", "δ"]) for _ in range(rng.randrange(0, 1500)))) for i in range(80)]
    rows += [(900, None), (901, ""), (None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (902, "word " * 6000)]
    got = packing.pack_documents(make(spark, rows), keep_ids=True).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            part = np.array(ids[start : start + n], dtype="<u4")
            want[doc_id, k, start, n, zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= max(-(-total // 2048), sum(2 * r.length > 2048 for r in got)) + 2
    assert packing.pack_documents(make(spark, [])).count() == 0


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_capacities(rule):
    lengths = np.random.default_rng(2).integers(1, 60, 400)
    bins, offsets = packing.best_fit(lengths, 64, 5, 3600, rule=rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 64 and len(own) <= 5 or len(own) == 1
        assert (own**2).sum() <= 3600
    with pytest.raises(ValueError):
        packing.best_fit([65], 64, 5, 10**6)


def brute_hits(text, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = word.findall(low(text or ""))
    hit, found = set(), set()
    for item, body in items:
        p = word.findall(low(body or ""))
        for k in range(max(1, len(p) - size + 1)) if p else ():
            pattern = p[k : k + size]
            for i in range(len(w) - len(pattern) + 1):
                if w[i : i + len(pattern)] == pattern:
                    hit.update(range(i, i + len(pattern)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(6)] + ["É", "straße", "X9"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "..!"), (None, say(14)), (3, say(15)), (60, "only")]
    rows = [(i, say(rng.randrange(0, 120)) + " " + (rng.choice(items)[1] or "").upper()) for i in range(40)] + [(90, None), (91, ""), (91, ""), (None, "Only, only!")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.judge(decontam.find_hits(make(spark, rows), bench, block_bytes=block_bytes, carry=True)).collect()
    want = Counter((i, *brute_hits(t, items, 13)[:2], tuple(brute_hits(t, items, 13)[2])) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) and r.doc.row == 7 for r in got)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert [r.n_items for r in decontam.judge(decontam.find_hits(make(spark, [(1, "a b")]), none)).collect()] == [0]
    assert decontam.find_hits(make(spark, []), none).count() == 0


def test_token_counts(spark, exact):
    exact.encode_special_tokens = True
    rows = list(enumerate(ODD)) + [(90, None), (None, "no id"), (1, ODD[1])]
    want = Counter((i, len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    exact.encode_special_tokens = False
    for block in (1, 7, 1 << 22):
        got = token_counts.document_token_counts(make(spark, rows), block_tokens=block).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want and all(r.terminated for r in got)
    assert token_counts.document_token_counts(make(spark, [])).count() == 0


def test_token_files(spark, tmp_path):
    def lengths(ids, block):
        np.array(ids, dtype="<u2").tofile(tmp_path / "a.bin")
        rows = token_counts.count_tokens(spark, f"file://{tmp_path}", separator=9, block_tokens=block).orderBy("doc_number").collect()
        return [(r.doc_number, r.start, r.n_tokens, r.terminated) for r in rows]

    for block in (1, 2, 3, 100):
        assert lengths([9, 1, 2, 9, 9, 3], block) == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 0, True), (3, 5, 1, False)]
        assert lengths([1, 2, 3, 4, 5, 6, 7], block) == [(0, 0, 7, False)]
        assert lengths([], block) == []


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRETS = [
    (1, "password: token: abcdefgh, Secret='a1b2c3d4' api_key==zzzzzz"), (2, None), (3, ""), (4, "é🙂 AKIA" + "Q1" * 9 + " AKIA12 " + "0123456789abcdef" * 2),
    (5, "TOKEN=deadbeef" + "0" * 30 + " x"), (6, " ".join(f"token = value{i:06d}" for i in range(700))), (7, "clean words only"), (7, "clean words only"), (None, "apikey:12345"),
    (8, "key qX7vLk29ZpR4mTq8WbNc5yJd here and user_account_name_index_2024 or https://example.com/path/to/some/report/2024"),
    (9, "---------- 2024 ========================1 1111111111111111111111a"),
]


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    found = secret_scan.scan(make(spark, SECRETS)).select("doc_id", secret_scan.listed(secret_scan.KINDS[:3]).alias("base"), secret_scan.listed(secret_scan.KINDS).alias("spans"), "random").collect()
    text = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert Counter((r.doc_id, r.base) for r in found) == Counter((i, text(base_spans(t))) for i, t in SECRETS)
    added = {r.doc_id: [s.value for s in r.random] for r in found if r.random}
    assert added == {8: ["qX7vLk29ZpR4mTq8WbNc5yJd"]}
    assert secret_scan.scan(make(spark, [])).count() == 0


def test_secret_model_tells_keys_from_names(spark):
    ratios = secret_scan.train(secret_scan.default_samples(spark))
    held = secret_scan.default_samples(spark, 900).where("length(text) >= 20").withColumn("r", secret_scan.mean_ratio(secret_scan.F.col("text"), ratios)).collect()
    right = [(r.r >= 0.5) == (r.label == 1) for r in held]
    assert sum(right) / len(right) > 0.95


def test_registry_digests(spark, tmp_path):
    make(spark, [(1, "token=abcdef1")]).write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = registry.op7_secret_scan(spark, str(tmp_path)).collect()
    assert row.base_sha256 == hashlib.sha256(b"assign:0:13").hexdigest() and row.spans == "assign:0:13" and row.n_assign == 1


def test_id_split(spark):
    rows = spark.createDataFrame([(0,), (12,), (None,), (-5,)], "doc_id long").select("doc_id", common.id_split("doc_id", 7).alias("k")).collect()
    assert [r.k for r in rows] == [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 for r in rows]
