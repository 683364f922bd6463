import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import language_model as M


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def part(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def test_seating_grows_as_the_process_does():
    n = 20_000
    c = np.full(n, 30)
    t = M._seated(c, np.full(n, 0.5), np.zeros(n), 0.4, np.arange(n), 3)[0].astype(int)
    rng, want = np.random.default_rng(0), []
    for _ in range(4000):
        tables = 1
        for k in range(1, 30):
            tables += rng.random() < 0.5 / (0.5 + k - 0.4 * tables)
        want.append(tables)
    assert t.min() >= 1 and t.max() <= 30 and abs(t.mean() - np.mean(want)) < 0.1
    assert M.seat(np.array([0, 1]), np.ones(2), 0.5, 1).tolist() == [0, 1]
    big = M.seat(np.array([10**9]), np.array([2.0]), 0.1, 1)
    assert 1 < big[0] < 10**4


def test_steps_draw_from_the_arrangements_own_probability():
    """Five customers of a dish beside ten tables of others: tables are as often as all their partitions weigh."""
    d, theta, others, p0, n = 0.6, 1.0, 10, 0.3, 20_000

    def parts(items):
        if not items:
            yield []
            return
        for rest in parts(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    want = np.zeros(6)
    for p in parts(list(range(5))):
        w = np.prod([(theta + d * (others + k)) * p0 for k in range(len(p))])
        for table in p:
            w *= np.prod([j - d for j in range(1, len(table))])
        want[len(p)] += w
    got = M.seat(np.full(n, 5), np.full(n, (theta + d * others) * p0), d, np.arange(n), grow=d * p0, tries=8)
    assert abs(np.bincount(got, minlength=6) / n - want / want.sum()).max() < 0.015
    z = np.array([0.3, 1.0, 2.5, 7.9, 8.0, 100.5])
    assert M._lgamma(z) == pytest.approx([math.lgamma(x) for x in z], abs=1e-9)


def test_predictive_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(["the", "a", "b", "c", "the"][(i * k) % 5] + "x" * ((i + k) % 3) for k in range(12))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.Model(docs, contexts=3)
    got = model.predictive().collect()
    unknown, back = model._constants()
    assert len(got) == model.v
    for s in range(2):
        assert sum(r.root[s] for r in got) + unknown[s] == pytest.approx(1)
    for k in range(len(model.contexts)):
        total = float(np.mean(back[:, k] * unknown))
        for r in got:
            seen = {p.k: p.p for p in r.seen}
            total += seen.get(k, float(np.mean(back[:, k] * np.array(r.root))))
        assert total == pytest.approx(1)


def test_scores(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, 1) for r in base] + [(9001, None, 2), (9002, "", 2), (9003, "The THE \x0bthe Zq\xa0zq", 2), (None, base[3].text, 2), (base[5].doc_id, base[5].text, 3), (9005, "and the " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = M.score(docs, dense=300).collect()
    other = {(r.doc_id, r.n_tokens): r for r in M.score(docs, dense=10**6).collect()}
    train = Counter(w for i, t, _ in rows if i is not None and part(i) for w in words_of(t))
    n, v = sum(train.values()), len(train)
    text = {}
    for i, t, _ in rows:
        text[i] = t
    assert len(got) == len(rows)
    better = []
    for r in got:
        own = words_of(text[r.doc_id])
        assert r.held_out == (part(r.doc_id) == 0) and r.train_tokens == n and r.n_tokens == len(own)
        assert r.n_known == sum(w in train for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
        assert r.score < 0 and r.score == pytest.approx(other[r.doc_id, r.n_tokens].score, rel=1e-5)
        if r.held_out and r.n_tokens > 50:
            better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9
    assert M.score(docs.limit(0)).count() == 0
    alone = M.score(docs.where("doc_id = 9002 OR doc_id IS NULL").where("doc_id IS NULL")).collect()
    assert len(alone) == 1 and alone[0].train_tokens == 0 and alone[0].score == 0


def test_every_preceding_word_has_a_restaurant(spark):
    # 200 words, each always followed by a word of its own: more contexts than any fixed number of frequent ones would hold.
    rows = [(i, " ".join(f"a{(i * 7 + k) % 200} b{(i * 7 + k) % 200}" for k in range(40))) for i in range(120)] + [(1000 + i, "a150 b150 a199 b199") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.Model(docs)
    got = model.predictive().collect()
    unknown, back = model._constants()
    train = [words_of(t) for i, t in rows if part(i)]
    assert len(model.contexts) == len({w for t in train for w in ["", *t[:-1]]}) > 200
    for k in range(len(model.contexts)):
        total = float(np.mean(back[:, k] * unknown))
        for r in got:
            total += {p.k: p.p for p in r.seen}.get(k, float(np.mean(back[:, k] * np.array(r.root))))
        assert total == pytest.approx(1)
    at = {h: k for k, h in enumerate(model.contexts.tolist())}
    seen = {r.w: {p.k: p.p for p in r.seen} for r in got}
    for i in range(200):
        assert seen[M._HASH(f"b{i}".encode())][at[M._HASH(f"a{i}".encode())]] > 0.5


def test_both_ways_of_seating_agree():
    """Drawing the number of tables at once, and customer by customer, from the same probabilities."""
    n, d = 20_000, 0.5
    for customers in (2, 7, 20):
        c, new, grow = np.full(n, customers), np.full(n, 0.8), np.full(n, 0.05)
        one, two = M.seat(c, new, d, np.arange(n), grow=grow), M._seated_apart(c, new, grow, d, 8, np.arange(n), 77)
        assert one.min() >= 1 and one.max() <= customers and abs(one.mean() - two.mean()) < 0.03 * two.mean(), customers
        assert abs(one.std() - two.std()) < 0.06 * two.std() + 0.01


def test_one_by_one_seats_as_by_openings():
    d, n = 0.6, 400
    one = [M._one_by_one(np.array([60]), np.array([0.7]), np.array([0.1]), d, k) for k in range(n)]
    two = M._seated(np.full(n, 60), np.full(n, 0.7), np.full(n, 0.1), d, np.arange(n), 5)
    assert abs(np.mean([t[0] for t, _ in one]) - two[0].mean()) < 1.0
    # The weight is that of the same choices: tables that are never opened.
    t, w = M._one_by_one(np.array([9]), np.array([0.0]), np.array([0.0]), d, 1)
    assert t[0] == 1 and w[0] == pytest.approx(sum(math.log(i - d) for i in range(1, 9)))
    many = M.seat(np.array([5000, 3, 2000]), np.full(3, 0.5), 0.8, np.arange(3), grow=np.full(3, 0.2))
    assert 10 < many[0] < 5000 and 1 <= many[1] <= 3


def test_a_worker_keeps_few_tables_of_arrangements():
    M._arrangements.cache_clear()
    rnd, kept = np.random.default_rng(5), []
    for most in (300, 1000, 20, 5, 700, 450, 12, 90):
        customers = np.append(rnd.integers(2, most, 50), most)
        got = M.seat(customers, np.full(51, 0.8), 0.6, np.arange(51), grow=0.3)
        kept.append(M._arrangements.cache_info().currsize)
        assert ((got >= 1) & (got <= customers)).all()
    assert max(kept) <= 4
