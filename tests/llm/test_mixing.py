import random

import numpy as np
import pytest

from pagemill.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert M.targets([0, 10]) == [0, 15]
    assert M.targets([10, 0]) == [15, 0] and M.targets([]) == [] and M.targets([0]) == [0]
    rnd = random.Random(1)
    sizes = [rnd.randint(0, 1000) for _ in range(50)]
    got = M.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shards_take_each_total_once():
    totals = np.array([0, 5, 1000, 313])
    at, nodes = np.zeros(4, int), {}
    shards = -(-1318 // 100)
    for k in range(shards):
        first, own = M.shard_slots(k, shards, totals, 100, 3, nodes)
        assert (first == at).all() and own.sum() == min(100, 1318 - 100 * k) and (own >= 0).all()
        assert all((x == y).all() for x, y in zip(M.shard_slots(k, shards, totals, 100, 3), (first, own)))
        at += own
    assert (at == totals).all()


def test_draws_without_replacement():
    counts, m = np.array([40, 0, 7, 13]), 25
    ours = np.array([M.drawn(np.random.default_rng(k), counts, m) for k in range(4000)])
    theirs = np.random.default_rng(0).multivariate_hypergeometric(counts, m, 4000)
    assert (ours.sum(1) == m).all() and (ours >= 0).all() and (ours <= counts).all()
    assert abs(ours.mean(0) - theirs.mean(0)).max() < 0.15 and abs(ours.var(0) / np.maximum(theirs.var(0), 1e-9) - 1)[[0, 2, 3]].max() < 0.12
    for m in (0, 1, 59, 60):
        assert M.drawn(np.random.default_rng(1), counts, m).sum() == m
    big = M.drawn(np.random.default_rng(2), np.array([7 * 10**11, 3 * 10**11]), 5 * 10**11)
    assert big.sum() == 5 * 10**11 and abs(big[0] - 35 * 10**10) < 10**7


def docs_of(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rnd.choice([0, 1, 5, 90, 700]))), rnd.choice(["a", "a", "a", "b", "ß", None]), 1) for i in range(300)]
    rows += [(500, None, "empty", 2), (7, rows[7][1], rows[7][2], 3), (7, rows[7][1], rows[7][2], 3), (None, "no id here", "b", 4), (901, "x\t y\n" * 5000, "b", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target int")


def test_takes(spark):
    rows, docs = docs_of(spark)
    got = M.Mix(docs, block=16, shard=500, chunks=8).takes().collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, M.Mix(docs, block=16, shard=500, chunks=8).takes().collect()))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, M.targets([sizes[s] for s in names])))
    own = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = {}
    for r in got:
        s = own[r.doc_id, r.size]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
    for s in names:
        assert abs(taken[s] - want[s]) <= max(16, 0.01 * want[s])
    assert M.Mix(docs.limit(0)).takes().count() == 0
    with pytest.raises(ValueError):
        M.Mix(docs, max_sources=2)


def test_mixed_holds_the_words_taken(spark):
    rows, docs = docs_of(spark)
    docs = docs.withColumnRenamed("target", "parts")
    kw = {"block": 16, "shard": 500, "chunks": 8}
    out = M.mixed(docs, **kw)
    assert out.columns == docs.columns
    words, want = {}, {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    for r in M.Mix(docs, **kw).takes().collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
    assert M.cut_out(" a b\tc d ", [(2, 1), (0, 1)]) == "a\nc" and M.cut_out(" a b ", [(1, 1), (0, 1)]) == " a b "
