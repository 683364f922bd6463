"""The divergence audit against a plain loop over all pairs and terms."""

import re
from collections import Counter, defaultdict

import numpy as np

from pagemill.llm import divergence


def plain(rows, least=3, most=200):
    words = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for a, b, t in rows]
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        seen[lang].update(set(w))
        groups[lang, source].update(w)
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: c for (k, s), c in groups.items() if k == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s, c in own.items():
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, o, -v, n) for part, found in (("pair", pair), ("term", term)) for n, (v, _, o) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value long, term string").repartition(4)


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in ("ab", "Straße", "漢字", "z") for b in "abcdefghijklmnopqrstuvwxyz"]
    return [(str(rng.choice(["en", "de"], p=[0.8, 0.2])), f"s{min(int(rng.geometric(0.1)), 40)}", " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for _ in range(n)]


def test_as_the_plain_loop(spark):
    rows = rows_of(400) + [("en", "hot", "the same words again and again " * 20)] * 150
    rows += [(None, None, "only here"), ("", None, "only here"), (None, "b", "only here ÄÖ"), ("en", "silent", None), ("en", "empty", "12 34 --"), ("xx", "a", "rare"), ("xx", "b", None), ("xx", "c", ""), ("en", "long", "word " * 50_000 + "x" * 100_000)]
    want = plain(rows)
    for kw in ({}, {"block": 3, "chunk": 16}, {"block": 1, "chunk": 1000}):
        assert sorted(tuple(r) for r in divergence.audit(table(spark, rows), **kw).collect()) == want
    assert {r[4] for r in want if r[0] == "xx"} == {0} and sum(r[0] == "xx" for r in want) == 6


def test_limits_of_terms_and_an_empty_table(spark):
    rows = rows_of(200, 2)
    got = divergence.audit(table(spark, rows), most_terms=3)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, most=3)
    assert divergence.audit(table(spark, rows).where("false")).collect() == []


def test_shares_of_large_counts(spark):
    counts, total = [0, 5, 10**9, 8 * 10**12], 9 * 10**12
    want = [1 + 10**9 * (c + 1) // total for c in counts]
    assert divergence.shares(np.array([counts]), np.array([total])).tolist() == [want]
    df = spark.createDataFrame([(c, total) for c in counts], "n long, t long")
    assert [r[0] for r in df.select(divergence.share("n", "t")).collect()] == want


def test_tasks_write_what_they_hold(spark):
    rows = rows_of(100, 3)
    few = divergence.tallied(table(spark, rows), most=10).groupBy("lang", "source", "term").sum("n", "docs")
    all_ = divergence.tallied(table(spark, rows)).groupBy("lang", "source", "term").sum("n", "docs")
    assert sorted(map(str, few.collect())) == sorted(map(str, all_.collect()))
