import random

from pyspark.sql import functions as F

from palimpsest.functions import geometry
from palimpsest.operators import blocks, boxes


def test_scopes_by_fold_and_by_join(spark):
    rng = random.Random(0)
    rows = [(page, i, rng.choice("qQsx"), rng.randrange(100)) for page in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "page int, seq int, op string, v int")
    args = (["page"], "seq", F.col("op") == "q", F.col("op") == "Q", F.col("op") == "s", F.col("v"))
    read = lambda d: sorted((r.page, r.seq, r.depth, r.value) for r in d.select("page", "seq", "depth", "value").collect())
    assert read(blocks.scope_values(df, *args)) == read(blocks.scope_values_joined(df, *args))


def test_strip_saturates(spark):
    ops = "ET a BT b BT c ET d ET e ET f".split()
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate(ops)], "page int, seq int, op string")
    kept = blocks.strip_blocks(df, ["page"], "seq", F.col("op") == "BT", F.col("op") == "ET").orderBy("seq")
    assert [r.op for r in kept.collect()] == ["a", "e", "f"]


def test_overlap_join_by_brute_force(spark):
    rng = random.Random(1)
    box = lambda: (x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 40), y + rng.uniform(0, 40))
    make = lambda name: [(i, i % 3, *box()) for i in range(60)]
    left, right = make("a"), [*make("b"), (99, 0, *[0.0] * 4)]
    left.append((77, 0, -10.0, -10.0, 0.0, 0.0))
    as_df = lambda rows, i, b: spark.createDataFrame(rows, f"{i} int, page int, x0 double, y0 double, x1 double, y1 double").select(i, "page", geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(b))
    a, b = as_df(left, "_id", "a"), as_df(right, "sid", "b")
    meet = lambda p, q: p[1] == q[1] and p[2] < q[4] and p[4] > q[2] and p[3] < q[5] and p[5] > q[3]
    want = sorted((p[0], q[0]) for p in left for q in right if meet(p, q))
    got = sorted((r._id, r.sid) for r in boxes.overlap_join(a, b, ["page"], "a", "b", 16.0).collect())
    assert got == want
    hit = {i for i, _ in want}
    for how, ids in (("left_semi", hit), ("left_anti", {p[0] for p in left} - hit)):
        assert {r._id for r in boxes.overlap_join(a, b, ["page"], "a", "b", 16.0, how).collect()} == ids


def test_merge_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 30, 31), (1, 1, 2), (2, 5, 6)], "k int, low int, high int")
    got = sorted((r.k, r.low, r.high, r.n) for r in boxes.merge_intervals(rows, ["k"], "low", "high", 2).collect())
    assert got == [(1, 0, 20, 3), (1, 30, 31, 1), (2, 5, 6, 1)]


def test_merge_intervals_with_equal_rows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), low := rng.randrange(2000) * 7, low + 4) for _ in range(6000)]
    want = []
    for k, low, high in sorted(rows):
        if want and want[-1][0] == k and low - want[-1][2] <= 3:
            want[-1] = (k, want[-1][1], max(high, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((k, low, high, 1))
    df = spark.createDataFrame(rows, "k int, low int, high int").repartition(16)
    assert len(set(rows)) < len(rows) * 0.7 and 100 < len(want) < 2500
    assert sorted((r.k, r.low, r.high, r.n) for r in boxes.merge_intervals(df, ["k"], "low", "high", 3).collect()) == want


def test_geometry_columns(spark):
    row = spark.range(1).select(
        geometry.pixel_to_page(*[F.lit(float(v)) for v in (900, 900, 100, 100, 100, 100)], F.lit(1000), F.lit(1000)).alias("p"),
        geometry.pixel_to_page(*[F.lit(1.0)] * 6, F.lit(0), F.lit(5)).alias("none"),
        geometry.page_to_pixels(geometry.box(*[F.lit(float(v)) for v in (50, 50, 100, 100)]), geometry.box(*[F.lit(float(v)) for v in (0, 0, 100, 100)]), F.lit(100), F.lit(100)).alias("i"),
        geometry.rect_box(geometry.matrix(*[F.lit(float(v)) for v in (2, 0, 0, 3, 100, 200)]), *[F.lit(float(v)) for v in (10, 20, 50, 30)]).alias("r"),
    ).first()
    assert tuple(row.p) == (90, 0, 100, 10) and row.none is None and tuple(row.i) == (50, 0, 50, 50) and tuple(row.r) == (120, 260, 220, 350)
