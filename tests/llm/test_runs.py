"""Repeated runs of lines against brute force."""

import random
from collections import Counter

from palimpsest.llm import line_dedup

SCHEMA = "doc_id long, text string, row long, at string"


def make(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(parts)


def brute(rows):
    """Rows of unique ids: text, lines and lines removed of each."""
    first, out = {}, Counter()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            row, at = first.setdefault(pair, (doc_id, i))
            if row != doc_id or i > at + 1:
                gone |= {i, i + 1}
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out[doc_id, None if text is None else "\n".join(kept), len(lines), len(gone)] += 1
    return out


def test_planted_passages(spark):
    """Passages of 2 to 6 lines, in different contexts, go whole but for the first."""
    rng = random.Random(0)
    fresh = iter(range(10**6))
    own = lambda: [f"own line {next(fresh)}" for _ in range(rng.randrange(1, 6))]
    passages = [[f"passage {n} {k} line {j}" for j in range(n)] for n in range(2, 7) for k in range(8)]
    rows, left = [], {}
    for i in range(200):
        here = rng.sample(passages, 2)
        a, b, c = own(), own(), own()
        rows.append((i, "\n".join([*a, *here[0], *b, *here[1], *c])))
        left[i] = [*a, *b, *c]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_runs(make(spark, rows)).collect()}
    seen = Counter(x for lines in got.values() for x in lines)
    assert all(seen[x] == 1 for p in passages for x in p)
    assert all([x for x in got[i] if x.startswith("own")] == left[i] for i in left)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(f"l{rng.randrange(12)}" for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n\n"), (903, "only é 🙂"), (904, "x\nx\nx\nx\nx"), (None, rows[3][1]), (905, rows[7][1])]
    got = line_dedup.dedup_runs(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_removed) for r in got) == brute(rows)
    assert all(r.row == 7 and r.at == "x" for r in got)
    lines = lambda texts: {x for t in texts if t is not None for x in t.split("\n")}
    assert lines(r.text for r in got) >= lines(t for _, t in rows)
    assert line_dedup.dedup_runs(make(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    got = line_dedup.dedup_runs(make(spark, [(1, text), (1, text), (1, text)])).collect()
    assert sorted(r._n_removed for r in got) == [0, 20, 20]


def test_chunks_are_the_seeds(spark, monkeypatch):
    """Repeated chunks are found and compared by op8's method; pairs within them are
    not compared again, and lines beside them, a chunk of one line too, go as well."""
    rng = random.Random(2)
    passages = [[f"passage {k} line {rng.random()}" for _ in range(30)] for k in range(4)]
    rows = [(i, "\n".join([f"own {i} a", *passages[i % 4], f"own {i} b", f"own {i} c"])) for i in range(40)]
    seeded, paired = [], []
    repeated, pairs = line_dedup.repeated, line_dedup.pair_rows
    monkeypatch.setattr(line_dedup, "repeated", lambda *a: seeded.append(repeated(*a)) or seeded[-1])
    monkeypatch.setattr(line_dedup, "pair_rows", lambda *a: paired.append(pairs(*a)) or paired[-1])
    got = line_dedup.dedup_runs(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_removed) for r in got) == brute(rows)
    inside = {(r.row, i) for r in seeded[0].collect() for i in range(r.at, r.to - 1)}
    left = {(r.row, r.at) for r in paired[0].collect()}
    assert inside and not inside & left and len(inside | left) == 40 * 32
