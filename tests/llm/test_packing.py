import random
import zlib

import numpy as np
import pytest

from pagemill.llm import packing as P


@pytest.fixture(scope="module")
def defines():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_tokenizers(defines):
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "word", "It's", "x9", "***", "é", "漢字", "😀", "<|endoftext|>", ",", "'ll", "²"]
    texts = ["", " ", "a", " a", "a ", "a\nb c", "\na", "a\n"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    encoder = P.Encoder(most=50)
    for t in texts:
        assert np.frombuffer(encoder(t), "<u4").tolist() == defines.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_by_hand():
    rnd = random.Random(4)
    sizes = sorted((rnd.randint(1, 50) for _ in range(400)), reverse=True)
    got = P.best_fit(sizes, 50)
    assert sorted(i for g in got for i in g) == list(range(400))
    rooms = []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        rooms.remove(min(fits)) if fits else None
        rooms.append((min(fits) if fits else 50) - s)
    assert len(got) == len(rooms) and sorted(50 - sum(sizes[i] for i in g) for g in got) == sorted(rooms)


def check(rows, want, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by)


@pytest.mark.parametrize("task_items", [50_000, 40])
def test_pack(spark, defines, task_items):
    rnd = random.Random(5)
    texts = [None, "", "x " * 30_000] + [" ".join(rnd.choice(["alpha", "beta", "gam\nma"]) for _ in range(rnd.choice([3, 30, 300]))) for _ in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[5], 1), (5, texts[5], 1)]
    want = []
    for i, t, _ in rows:
        ids = defines.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 512 or 512, len(ids), 512), len(ids)]
        want += [(i is None, i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    cut = P.pieces(docs, capacity=512)
    n = check(P.pack(cut, capacity=512, task_items=task_items).collect(), sorted(want), 512)
    least = -(-sum(x[4] for x in want) // 512)
    assert least <= n <= 1.1 * least + 1
    assert P.pack(P.pieces(docs.limit(0))).count() == 0
    ids = P.pieces(docs, capacity=512, with_ids=True).where("doc_id = 2").orderBy("piece").collect()
    assert [x for r in ids for x in r.ids] == defines.encode(texts[2], add_special_tokens=False).ids + [0]
