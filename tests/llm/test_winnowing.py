import hashlib
import random

import numpy as np
import pytest
import xxhash

from pagemill.llm import winnowing as W


def marks_by_hand(hashes, window):
    if not hashes:
        return []
    window = min(window, len(hashes))
    out = []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == least)
        if not out or out[-1] != at:
            out.append(at)
    return out


@pytest.mark.parametrize("chunks", [1, 7, None])
def test_next_and_edited(spark, chunks, monkeypatch):
    rnd = random.Random(2)
    rows = [(i * 3, " ".join(rnd.choice(["é", "😀x", "word", "z"]) for _ in range(rnd.choice([0, 1, 9, 60]))), 1) for i in range(60)]
    rows += [(500, None, 2), (501, "", 2), (None, "last of all here", 3), (180, "y " * 20000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, guest int")
    old = W.with_next
    monkeypatch.setattr(W, "with_next", lambda d, a, b: old(d, a, b, chunks))
    got = {r.doc_id: r for r in W.report(W.edited_next(docs)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for (i, text, _), (j, after, _) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert got[500].near_next == 1 and got[500].fingerprint == got[501].fingerprint
    assert W.report(W.edited_next(docs.limit(0))).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id, r.near_next) for r in W.report(W.edited_next(docs)).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 0.0)]


def test_texts_without_spaces(spark):
    rnd = random.Random(5)
    chinese = lambda n: "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(n))
    shared = chinese(47)
    docs = spark.createDataFrame([(1, chinese(1000)), (2, chinese(700) + shared + chinese(80)), (3, chinese(11) + shared + chinese(300))], "doc_id long, text string")
    got = {r.doc_id: r for r in W.report(W.edited_next(docs)).collect()}
    assert 0.2 < got[1].near_edited < 0.5 and got[1].n_marks > 30
    assert got[2].near_next > 0


def chosen_by_hand(text, k, window):
    """Hash and place of the runs that a plain loop over windows chooses."""
    points = "".join(c for c in text.lower().replace("ς", "σ") if c not in " \t\n\x0b\x0c\r")
    runs = [points[j : j + k] for j in range(len(points) - k + 1)] or ([points] if points else [])
    hs = [int(np.uint64(xxhash.xxh64_intdigest(r.encode("utf-32-be"), 42)).view(np.int64)) >> 31 for r in runs]
    return [(hs[j], j) for j in marks_by_hand(hs, window)]


def read(marks):
    return [(m >> 31, W._AT - (m & W._AT)) for m in marks]


@pytest.mark.parametrize("piece", [7, 4096])
def test_marks_and_edited_marks_by_brute_force(spark, monkeypatch, piece):
    """Marks, edited texts' marks and both likenesses are those of plain loops, in pieces of any length."""
    rnd = random.Random(7)
    texts = ["", " ", "x", "Ab c", "漢" * 15, "漢" * 16, "😀é" * 40, "abc" * 5, "ΑΣ", "ΑΣ b", " \t"] + ["".join(rnd.choice("ab \nΣİ漢😀cdefgh") for _ in range(rnd.choice([3, 20, 46, 47, 48, 93, 94, 95, 200, 1000]))) for _ in range(50)] + ["z" * 500, "z" * 500, "ab" * 300]
    texts += ["".join(rnd.choice("abcdef") for _ in range(9000)), "y", "".join(rnd.choice("abcdef") for _ in range(12_000)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1])]
    monkeypatch.setattr(W, "_PIECE", piece)
    for k, window in ((16, 32), (3, 5), (1, 1), (2, 4)):
        plain = [(chosen_by_hand(t, k, window), chosen_by_hand(e, k, window)) for t, e in zip(texts, edited)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        got = {r.doc_id: r for r in W.edited_next(docs, k=k, window=window).collect()}
        assert len(got) == len(texts)
        for i, r in got.items():
            own, new, after = (({h for h, _ in m}) for m in (*plain[i], plain[(i + 1) % len(texts)][0]))
            assert read(r.marks) == plain[i][0], (i, k, texts[i])
            assert read(r.edited_marks) == plain[i][1], (i, k, edited[i])
            assert r.near_edited == pytest.approx(like(own, new)) and r.near_next == pytest.approx(like(own, after)) and r.n_marks == len(plain[i][0])


def test_shared_passages_share_a_mark(spark):
    rnd = random.Random(8)
    rows = []
    for n in range(50):
        shared = "".join(rnd.choice("abcdef") for _ in range(47))
        a, b = ("".join(rnd.choice("ghijk") for _ in range(rnd.randrange(300))) for _ in range(2))
        rows += [(n, a + shared + b), (n, b + shared + a)]
    found = {}
    for r in W.with_marks(spark.createDataFrame(rows, "n int, text string"), "text", "marks").collect():
        found.setdefault(r.n, []).append({h for h, _ in read(r.marks)})
    assert len(found) == 50 and all(a & b for a, b in found.values())


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = W.edited_next(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
