"""Importance resampling against a plain loop over dictionaries."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from pagemill.llm import importance

TEXTS = [(1, "The cat sat. the CAT"), (2, None), (3, ""), (4, "the cat sat " * 12), (5, "Ärger über ÄRGER 漢字 x1-y2"), (6, "a" * 30_000), (7, "lorem ipsum dolor " * 3000), (7, "lorem ipsum dolor " * 3000), (None, "dogs " * 25)]
TEXTS += [(k, f"word{k % 7} of the many " * 6) for k in range(100, 160)]
TARGET = [("the cat sat on many mats",), (None,), ("of the many",)]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), Counter(crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain(texts, target):
    own, aim = [features(t) for _, t in texts], sum((features(t)[1] for (t,) in target), Counter())
    every = sum((c for _, c in own), Counter())
    s, t = every.total(), aim.total()
    out = []
    for (doc, _), (words, counts) in zip(texts, own, strict=True):
        weight = sum(n * math.floor(1000 * math.log((aim[b] + 1.0) * (s + 10_000) / ((every[b] + 1.0) * (t + 10_000)))) for b, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, counts.total(), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(str((*r, ranks.get(id(r)))) for r in out)


def test_as_the_plain_loop(spark):
    docs = spark.createDataFrame([(*r, 0, 0, "x") for r in TEXTS], "doc_id long, text string, score long, rank long, part string").repartition(5)
    got = importance.resample(docs, spark.createDataFrame(TARGET, "text string"))
    want = plain(TEXTS, TARGET)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert sum("None)" not in r for r in want) == 3  # of 64 long ones


def test_blocks_hold_every_entry(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    small, large = importance.count_matrix(docs, block_entries=50), importance.count_matrix(docs)
    assert small.count() > 10 and large.count() < small.count()
    assert importance.column_sums(small) == importance.column_sums(large)
    many = [0] * 10_000
    for _, t in TEXTS:
        for b, n in features(t)[1].items():
            many[b] += n
    assert importance.column_sums(small) == many


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert sorted(str(tuple(r)) for r in importance.resample(docs, none).collect()) == plain(TEXTS, [])
    assert importance.resample(docs.where("false"), none).collect() == []
    few = importance.resample(docs.where("doc_id < 4"), none).collect()
    assert [r["rank"] for r in few] == [None] * 3


def test_blocks_are_small_enough_to_be_read_by_thousands(spark):
    """A task reads 4096 rows of a stored table at once."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(200))) for k in range(60)], "doc_id long, text string").coalesce(1)
    sizes = [len(r.buckets) + len(r.counts) for r in importance.count_matrix(docs).collect()]
    assert len(sizes) > 5 and max(sizes) < 6 * (2048 + 600)
