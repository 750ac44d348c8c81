"""Near duplicates, substring and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from palimpsest.llm import components, line_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, row long, class string"


def make(spark, rows, parts=3):
    """rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(parts)


def words(rng, n, pool=2000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(seed=0, n=60):
    """Originals, exact and near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 200)) for _ in range(n)]
    passage = words(rng, 60)
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        c = b[:]
        c[rng.randrange(len(c))] = "changed"
        texts += [" ".join(c), " ".join(b)]
    for b in base[15:30]:
        at = rng.randrange(len(b))
        texts.append(" ".join(b[:at] + passage + b[at:]))
    rows = list(enumerate(texts))
    return rows + [(500, None), (501, ""), (502, "  \n "), (503, "one two"), (504, "one two"), (None, texts[0]), (3, texts[3]), (505, "a " * 120), (506, "\t".join(["x"] * 90))]


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def test_near_duplicates(spark):
    rows = corpus()
    links = brute_links(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, js in enumerate(links):
        for j in js:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    want = Counter((rows[i][0], least(members[find(i)]), len(links[i])) for i in range(len(rows)))
    got = ngram_join.near_duplicates(make(spark, rows), chunk_rows=3).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.is_first for r in got) == len(members)


def test_near_duplicates_empty(spark):
    assert ngram_join.near_duplicates(make(spark, [])).count() == 0
    assert [r.n_links for r in ngram_join.near_duplicates(make(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_bands():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 320


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (100, 102), (7, 7), (0, 1)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(30)}}


def brute_windows(rows, size):
    split = [(t or "").encode().split() for _, t in rows]
    split = [[x.decode() for x in w] for w in split]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("seed", "size"), [(0, 35), (1, 35), (2, 6)])
def test_substring_dedup(spark, seed, size):
    rows = corpus(seed)
    got = substring_dedup.dedup(make(spark, rows), size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_windows(rows, size)


def test_substring_dedup_few_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 300), 2))) for i in range(40)]
    got = substring_dedup.dedup(make(spark, rows), 12).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_windows(rows, 12)
    assert substring_dedup.dedup(make(spark, [])).count() == 0


def brute_lines(rows, divisor, least):
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = None if text is None else text.encode().split(b"\n")
        kept = []
        for a, b in line_dedup.chunks(lines or [], divisor):
            body = b"\n".join(lines[a:b])
            if b - a < least or first.setdefault(body, True) is True and not first.update({body: False}):
                kept += lines[a:b]
        out.append((doc_id, None if text is None else b"\n".join(kept).decode(), len(lines or []), len(lines or []) - len(kept)))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(3)
    passage = [f"shared {i}" for i in range(14)]
    rows = []
    for i in range(40):
        lines = [f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 15))]
        if i % 3 == 0:
            at = rng.randrange(len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "\n\n\n\n\n\n\n\n"), (104, "\n" * 30), (None, rows[3][1]), (105, "same\n" * 50)]
    got = line_dedup.dedup(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_removed) for r in got) == brute_lines(rows, 3, 2)
    assert {r.row for r in got} == {7} and sum(r._n_removed for r in got) > 50
    assert line_dedup.dedup(make(spark, [])).count() == 0


def test_line_dedup_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    got = sorted(r._n_removed for r in line_dedup.dedup(make(spark, [(1, text), (1, text), (1, text)])).collect())
    gone = sum(b - a for a, b in line_dedup.chunks(text.encode().split(b"\n"), 3) if b - a >= 2)
    assert got == [0, gone, gone]


def test_chunks_cover_all_lines():
    lines = [hashlib.md5(bytes([i])).digest() for i in range(100)]
    found = line_dedup.chunks(lines, 3)
    assert found[0][0] == 0 and found[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
