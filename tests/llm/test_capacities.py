"""Packing keeps document and attention-cost capacities that bind."""

from collections import defaultdict

from palimpsest.llm import packing


def test_binding_capacities(spark, tmp_path):
    lengths = [1 + i * 7 % 40 for i in range(300)]
    spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").write.parquet(str(tmp_path / "pieces"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "pieces")), capacity=128, max_docs=4, max_cost=2500).collect()
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append(r.length)
    assert sorted(r.length for r in got) == sorted(lengths)
    assert all(sum(x) <= 128 and len(x) <= 4 and sum(n * n for n in x) <= 2500 for x in held.values())
    loose = packing.pack(spark.read.parquet(str(tmp_path / "pieces")), capacity=128).select("sequence_id").distinct().count()
    assert len(held) > loose
