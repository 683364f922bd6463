import numpy as np
import pytest

from pagemill.llm import hnsw as H


def clusters(seed, n, group, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(0, n // 2, group):
        x[c : c + group] = x[c] + 0.08 * rng.standard_normal((len(x[c : c + group]), dim))
    return x.astype(np.float32).astype(np.float64)


def true_links(x, y, least=0.95):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit(x) @ unit(y).T >= least


@pytest.mark.parametrize("n, group", [(1, 1), (5, 2), (900, 3), (1500, 200)])
def test_shard_recall(n, group):
    x = clusters(n, n, group)
    shard = H.Shard(x, 0.95)
    found = shard.links(x)
    want = true_links(x, x)
    got = np.zeros_like(want)
    for i, f in enumerate(found):
        got[i, f] = True
    assert not (got & ~want).any() and got.sum() >= 0.98 * want.sum()
    assert shard.recalls


def test_audit_widens_the_beam(monkeypatch):
    x = clusters(1, 600, 6)
    full = H.Shard._found
    monkeypatch.setattr(H.Shard, "_found", lambda self, q: full(self, q) if self.beam >= 8 else [np.zeros(0, np.int64)] * len(q))
    shard = H.Shard(x, 0.95, beam=2)
    found = shard.links(x[:200])
    assert shard.beam == 8 and len(shard.recalls) == 3 and shard.recalls[0][0] < shard.recalls[0][1]
    assert sum(map(len, found)) >= 0.98 * true_links(x[:200], x).sum()


def test_table(spark):
    x = clusters(7, 400, 5, 8)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000 + k, x[3].tolist(), 2) for k in range(50)] + [(3, x[3].tolist(), 9)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    table = spark.createDataFrame(rows + [(*r, 3) for r in odd], "vec_id long, embedding array<float>, n_links int")
    got = H.near_duplicates(table, min_shards=3).collect()
    assert len(got) == len(rows) + len(odd)
    ids = [r[0] for r in rows]
    links = true_links(np.array([r[1] for r in rows]), np.array([r[1] for r in rows]))
    np.fill_diagonal(links, False)
    label = list(ids)
    for _ in range(20):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(len(ids))]
    want = sorted((i, int(links[k].sum()), label[k]) for k, i in enumerate(ids))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 2000) == want
    alone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id >= 2000}
    assert alone == {**{i: (0, i, True) for i in range(2000, 2006)}, 2006: (1, 2006, True), 2007: (1, 2006, False)}
    assert len({r.recall for r in got}) == 1 and got[0].recall >= 0.98
    assert H.near_duplicates(table.limit(0)).count() == 0


def test_many_dimensions_and_small_shards(spark):
    x = clusters(9, 120, 4, 700)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    links = true_links(x.astype(np.float32).astype(float), x.astype(np.float32).astype(float))
    np.fill_diagonal(links, False)
    for kw in ({"min_shards": 1}, {"min_shards": 1, "shard_bytes": 100_000}):
        got = {r.vec_id: r.n_links for r in H.near_duplicates(table, **kw).collect()}
        assert got == {k: int(n) for k, n in enumerate(links.sum(1))}


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(H, "near_links", lambda nodes, least, **kw: nodes.sparkSession.createDataFrame([(None, None, 8, 10)], "a long, b long, n long, there long"))
    with pytest.raises(RuntimeError):
        H.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>"))
