import random

import numpy as np
import xxhash

from pagemill.llm import simhash as S
from pagemill.llm.common import components


def by_hand(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def roots_by_hand(fps, bits=3):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_fingerprints(monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", " \n", "one", "One TWO", "a b c", "Ünï\u00a0x y\x0bz ÀB"] + [" ".join(rnd.choice("abcdefgÄ") for _ in range(n)) for n in (5, 50, 333)]
    assert [S.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]
    monkeypatch.setattr(S, "_PIECE", 7)
    assert [S.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]


def test_sets_hold_every_link():
    assert len(S.SETS) == 14
    for bad in ((a, b, c) for a in range(8) for b in range(a) for c in range(b)):
        assert sum(not set(s) & set(bad) for s in S.SETS) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_against_all_pairs(spark):
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rnd.choice(fps)
        for k in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << k
        fps.append(x)
    fps = sorted(set(fps), key=lambda x: int(np.uint64(x).view(np.int64)))
    want = roots_by_hand(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    for block in (2048, 3):
        edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
        got = {r.node: r.root for r in components(edges).collect()}
        assert [got.get(x, x) for x in signed] == [signed[k] for k in want]


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(4, text, 1), (2, text, 2), (9, "", 3), (7, None, 4), (None, text, 5), (None, "alone here now", 6), (2, text, 2), (11, text + " more", 7), (12, "x " * 60000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.report(S.near_duplicates(docs)).collect()), key=str)
    assert len(got) == len(rows) and {r[2] for r in got if r[0] in (2, 4)} == {2}
    near = (S.fingerprint(text) ^ S.fingerprint(text + " more")).bit_count() <= 3
    assert [r[2] for r in got if r[0] == 11] == [2 if near else 11]
    assert {r[2] for r in got if r[0] is None} == {2, None}
    assert {(r[0], r[2]) for r in got if r[0] in (7, 9)} == {(7, 7), (9, 7)} and (9, "0" * 16, 7) in got
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(2) == 1 and 4 not in ids and ids.count(None) == 1 and 7 in ids and 9 not in ids and 12 in ids
    assert S.keep_first(docs.limit(0)).count() == 0
