import zlib

import numpy as np

from pagemill.llm import language_id as L


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = L.Network(3, 3, 1)
    for k in net.NAMES:
        setattr(net, k, rng.standard_normal(getattr(net, k).shape) * 0.5)
    x, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    real = np.arange(6)[:, None] < np.array([6, 3, 1, 5])[None]
    _, g = net.gradients(x, real, y)
    for k in net.NAMES:
        w = getattr(net, k)
        for at in [tuple(rng.integers(0, n) for n in (*w.shape[:1], min(5, w.shape[1]), *w.shape[2:])[: w.ndim]) if w.ndim > 1 else (rng.integers(0, w.shape[0]),) for _ in range(12)]:
            old = w[at]
            w[at] = old + 1e-4
            up = net.gradients(x, real, y)[0]
            w[at] = old - 1e-4
            down = net.gradients(x, real, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 1e-5, (k, at)


def test_segments():
    data, length, of = L.segments([b"abcde", b"", b"xy"], 4)
    assert data.tolist() == [[97, 98, 99, 100], [101, 0, 0, 0], [120, 121, 0, 0]] and length.tolist() == [4, 1, 2] and of.tolist() == [0, 0, 2]


def test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    strange = spark.createDataFrame([(9001, None, "en"), (9002, "123 ²!", "de"), (9003, "", "en"), (None, "der die das und ein", "de"), (9005, "the of and " * 20000, None)], "doc_id long, text string, lang string")
    docs = table.select("doc_id", "text", "lang").unionByName(strange)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    langs = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    assert len(got) == len(langs) + 5
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003)) and got[9005].lang_pred == "en"
    held = [i for i in langs if got[i].held_out]
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.where("doc_id > 8999").drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_stage_keeps_clean_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = table.limit(1).selectExpr("9001L doc_id", "cast(null as string) text", "lang", "source", "n_chars").unionByName(table.limit(1).selectExpr("9002L doc_id", "'--- 12' text", "lang", "source", "n_chars"))
    kept = L.keep_known(table.unionByName(extra))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == table.columns and not ids & {9001, 9002} and len(ids) >= 198
