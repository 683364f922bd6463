"""The pipeline against plain loops over each stage's own input."""

import zlib

import numpy as np

import corpus_pipeline as C
from pagemill.llm import mixing, packing, secret_scan, simhash


def test_stages(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 ---", None, None, 6), (9003, "user: bob\nkey wJalrXUtnFEMIK7MDENGbPxRfiCY1 and the of " * 3, "en", None, None), (None, "the and of in to is " * 9, "en", "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    base.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {}
    for name, stage in C.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = (before.collect(), docs.collect())

    was, now = rows["language ID"]
    assert {r.doc_id for r in was} - {r.doc_id for r in now} <= {9001, 9002} | {r.doc_id for r in was if len(r.text or "") < 20}
    assert not {9001, 9002} & {r.doc_id for r in now}

    was, now = rows["SimHash near-dedup"]
    fps = [simhash.fingerprint(r.text) for r in was]
    label = list(range(len(was)))
    for _ in range(len(was)):
        new = [min(label[j] for j in range(len(was)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(was))]
        if new == label:
            break
        label = new
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(was[i].doc_id)
    want = sorted(str(min((x for x in g if x is not None), default=None)) for g in groups.values())
    assert sorted(str(r.doc_id) for r in now) == want

    was, now = rows["secret scans"]
    texts = {r.doc_id: r.text for r in now}
    assert len(was) == len(now)
    for r in was:
        spans = any(len(m[2]) >= 12 for m in __import__("re").finditer(secret_scan.ASSIGN, r.text))
        assert (secret_scan.MARK in texts[r.doc_id]) or not spans
        assert secret_scan.MARK in texts[r.doc_id] or texts[r.doc_id] == r.text
    assert texts[9003].count(secret_scan.MARK) == 6

    was, now = rows["mixing"]
    sizes, taken = {}, {}
    for r in was:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in now:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, mixing.targets([sizes[s] for s in names])):
        assert abs(taken.get(s, 0) - t) <= 70

    was, now = rows["best-fit packing"]
    encoder, want = packing.Encoder(), []
    for r in was:
        ids = encoder(r.text or "") + b"\0\0\0\0"
        cuts = [0, *range(len(ids) // 4 % 2048 or 2048, len(ids) // 4, 2048), len(ids) // 4]
        want += [(str(r.doc_id), b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]
    assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in now) == sorted(want)
    fill = {}
    for r in now:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.1 * np.ceil(sum(fill.values()) / 2048) + 1


def test_run(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
