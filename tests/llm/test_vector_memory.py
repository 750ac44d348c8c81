"""Vector search hashes and compares in bounded memory, exactly within its buckets."""

import tracemalloc

import numpy as np

from palimpsest.llm import vector_search


def test_hashing_of_many_buckets_is_bounded():
    """A large table's buckets have two axes: 16,384 for each query to order."""
    x = vector_search.unit(np.random.default_rng(0).normal(size=(2048, 64)))
    hashing = vector_search.CrossPolytope(64, 1, 2)
    tracemalloc.start()
    near = hashing.order(x, 0, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.shape == (2048, 128) and peak < 100 << 20
    assert (hashing.order(x[700:701], 0, 128) == near[700]).all() and (near[:, :1] == hashing.buckets(x)).all()


def test_best_of_probed_buckets():
    """Against a plain loop: rows of probed buckets only, ties to the smaller id, nulls
    last, then the row; copies of a vector beyond what a query can return."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8))
    v[100:400] = v[7]
    v = vector_search.unit(v)
    rows = rng.permutation(600).astype(np.int64)
    ids = [None if i % 50 == 9 else int(i) for i in rng.integers(0, 300, 600)]
    lying = np.where(np.arange(600) < 400, 3, rng.integers(0, 6, 600))
    asks = rng.choice(600, 60, replace=False)
    probes = [rng.choice(8, 3, replace=False) for _ in asks]
    pairs = np.repeat(np.arange(60), 3), np.concatenate(probes)
    got = vector_search._best(rows[asks], [ids[i] for i in asks], v[asks], rows, ids, v, 5, pairs, lying).to_pylist()
    for i, near in zip(asks, probes, strict=True):
        there = [j for j in np.flatnonzero(np.isin(lying, near)) if j != i]
        want = sorted(there, key=lambda j: (-(v[i] * v[j]).sum(), ids[j] is None, ids[j] or 0, rows[j]))[:5]
        mine = [r for r in got if r["query_row"] == rows[i]]
        assert [r["row"] for r in mine] == [rows[j] for j in want] and [r["id"] for r in mine] == [ids[j] for j in want]
        assert sum(r["seen"] for r in mine) == len(there) * bool(mine)
