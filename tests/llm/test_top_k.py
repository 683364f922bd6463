"""Exact top-k search against all pairs."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import top_k


def plain(rows, k=20):
    points = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(points):
        if i % 20 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, p, strict=True)))), j) for b, (j, p) in enumerate(points) if a != b and len(p) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.5, 7) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int").repartition(3)


def same(spark, rows, **kw):
    got = sorted(tuple(r) for r in top_k.top_k(rows_of(spark, rows), **kw).collect())
    assert got == plain(rows)
    return got


def test_random_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (900, 6)))]
    rows += [(1000 + i, rows[40][1]) for i in range(200)]  # a large group of copies, queries among them
    rows += [(2000 + i, [0.0] * 6) for i in range(60)] + [(3000 + i, [0.25 * (i % 3), 0, 0, 0, 0, 0.5]) for i in range(90)]
    rows += [rows[20], rows[20], (20, rows[7][1]), (-40, rows[8][1])]  # repeated rows, an id with two vectors
    assert len(same(spark, rows)) > 1000
    same(spark, rows, min_shards=64, sample=100, block=7, box_bytes=500)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(20, [0.5, -0.5]), (40, None), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [0.5, 0.5]), (120, []), (121, []), (140, [1.0]), (160, [1.0, 2.0, 3.0]), (3, [0.25, 0.25]), (4, [0.25, 0.25])]
    assert same(spark, odd) == [(20, 1, 3, 0), (20, 2, 4, 0), (120, 1, 121, 0)]
    same(spark, [(0, [1e17, 1.0]), (1, [1e17, -1.0]), (2, [-1e17, 0.0]), (3, [1e300, 0.0])])
    assert top_k.top_k(rows_of(spark, odd).where("false")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.integers(1, 200), st.integers(1, 9))
def test_a_tree_finds_what_a_scan_finds(seed, dim, n, k):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(-4, 5, (n, dim)), axis=0)
    ids = [sorted(rng.integers(0, 500, rng.integers(1, 4)).tolist()) for _ in x]
    tree = top_k.Tree.loaded(top_k.Tree.build(x, ids, leaf=3).saved())
    q = rng.integers(-4, 5, (8, dim))
    for query, got in zip(q, tree.search(q, [-1] * 8, [(float("-inf"), 0)] * 8, k), strict=True):
        assert sorted(got, reverse=True) == sorted(((int(p @ query), -i) for p, own in zip(x, ids, strict=True) for i in own), reverse=True)[:k]


def test_boxes_prune(spark):
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.normal(c, 3, (400, 8)).astype(int) for c in rng.normal(0, 60, (20, 8))]), axis=0)
    tree = top_k.Tree.build(x, [[i] for i in range(len(x))])
    tree.search(x[:50], [-1] * 50, [(float("-inf"), 0)] * 50, 20)
    assert tree.opened < 50 * (tree.right < 0).sum() / 4
