"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 to G-1 share one weight vector over hashed text features; ordered thresholds t turn a
document's score s into P(grade > j) = 1 / (1 + exp(t_j - s)). From those come the expected grade and
the tail probability P(grade >= `tail`) that selects documents.

Features are the presence of a word (A-Z lower-cased, ASCII marks stripped from its ends), of the
marks before and after words, and of a level for each of a few shares of the text (words with marks,
words in capitals, repeated words, repeated lines). A document's score so doesn't fade with its length.
The fit is by proximal gradient steps with an L1 penalty, on at most about `ratings` ratings chosen by a hash;
features seen in fewer than `least` of them have no weight.

Ratings here: a toxic document has grade 0, another of low quality 1, any other 2.

Defined cases: a null text is an empty one and is scored like any other; ratings with a null are left
out, repeated ones count each; without ratings every document gets the middle of all outcomes (tail
probability 0.5, kept); repeated rows stay; only doc_id, text and the ratings' columns are read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BUCKETS = 1 << 18
GRADES = 3
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LEVELS = (0.02, 0.1, 0.3, 0.6)


def features(text: str | None) -> np.ndarray:
    """Sorted buckets of a text's features."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    found, marked, capital = set(), 0, 0
    for word, n in counts.items():
        bare = word.strip(_MARKS)
        if bare != word:
            a = word.find(bare) if bare else len(word)
            found.add(b"<" + word[:a][:8])
            found.add(b">" + word[a + len(bare) :][:8])
            marked += n * (len(word) - len(bare) > 1 or not bare)
        if len(bare) > 1 and bare.isupper():
            capital += n
        found.add(bare.lower())
    lines = [x for x in data.split(b"\n") if x.strip()]
    many = max(1, len(words))
    shares = (marked / many, capital / many, (len(words) - len(counts)) / many, (len(lines) - len(set(lines))) / max(1, len(lines)))
    found.update(b"=%d>%d" % (i, k) for i, x in enumerate(shares) for k, level in enumerate(_LEVELS) if x > level)
    found.discard(b"")
    return np.unique(np.array([xxhash.xxh32_intdigest(f) % BUCKETS for f in found], np.int64))


class Model:
    """Weights by bucket and thresholds in rising order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) of each score, for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -60, 60)))


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, grade_count: int = GRADES, steps: int = 300, rate: float = 0.3, l1: float = 2e-4, least: int = 4) -> Model:
    """Maximum likelihood with an L1 penalty: accelerated proximal steps, each bucket scaled by its frequency."""
    of, bucket = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)
    seen = np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(seen >= least)
    number = np.full(BUCKETS, -1)
    number[used] = np.arange(len(used))
    keep = number[bucket] >= 0
    of, bucket = of[keep], number[bucket[keep]]
    n = len(rows)
    scale = np.sqrt(np.maximum(seen[used], 1) / n)
    share = np.cumsum(np.bincount(grades, minlength=grade_count) + 0.5)[:-1] / (n + 0.5 * grade_count)
    first, gaps = np.log(share[0] / (1 - share[0])), np.log(np.maximum(1e-3, np.diff(np.log(share / (1 - share)))))
    theta = np.concatenate([[first], gaps])
    w = y = np.zeros(len(used))
    moment, square, turn = np.zeros_like(theta), np.zeros_like(theta), 1.0
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(of, weights=y[bucket], minlength=n)
        f = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        ends = np.concatenate([[-40.0], t, [40.0]])
        hi, lo = f(ends[grades + 1] - s), f(ends[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        edge = (dhi - dlo) / n  # d loss / d score
        g = np.bincount(bucket, weights=edge[of], minlength=len(used))
        dt = np.array([(dlo[grades == j + 1].sum() - dhi[grades == j].sum()) / n for j in range(grade_count - 1)])
        dtheta = np.array([dt.sum(), *(np.exp(theta[j]) * dt[j:].sum() for j in range(1, grade_count - 1))])
        moment, square = 0.9 * moment + 0.1 * dtheta, 0.99 * square + 0.01 * dtheta**2
        theta = theta - 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        stepped = y - rate * g / scale
        new = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * l1 / scale, 0)
        after = (1 + np.sqrt(1 + 4 * turn**2)) / 2
        if ((y - new) * (new - w)).sum() > 0:  # momentum that points uphill is dropped
            after, turn = 1.0, 1.0
        y, w, turn = new + (turn - 1) / after * (new - w), new, after
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def fit(docs: DataFrame, ratings: DataFrame, most: int = 12_000, seed: int = 5, grade_count: int = GRADES, **kw) -> Model | None:
    """ratings: (doc_id, grade). The sample of ratings, about `most`, is broadcast to find its texts; buckets of those come to the driver."""
    known = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    # A document that is rated several times has its lowest grade; one that is repeated is learned from once.
    rated = known.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
    sample = rated.where(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()).astype(np.int32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "buckets"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    got = own.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, buckets array<int>").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("grade").to_pylist(), got.column("buckets").to_pylist(), strict=True))
    if not rows:
        return None
    return fit_rows([np.array(r[2], np.int64) for r in rows], np.array([r[1] for r in rows]), grade_count, **kw)


def score(docs: DataFrame, model: Model | None, tail: int = 2, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, keep, expected_grade, tail_probability); keep is tail_probability >= least."""
    weights = None if model is None else (np.flatnonzero(model.weights).astype(np.int32), model.weights[np.flatnonzero(model.weights)], model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if weights is not None:
            own = np.zeros(BUCKETS, np.float32)
            own[weights[0]] = weights[1]
            held = Model(own, weights[2])
        for b in batches:
            if weights is None:
                above = np.full((b.num_rows, GRADES - 1), 0.5)
            else:
                above = held.above(np.array([float(held.weights[features(t.as_py())].sum(dtype=np.float64)) for t in b.column("text")]))
            p = above[:, tail - 1] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p >= least), pa.array(above.sum(1)), pa.array(p)], ["doc_id", "keep", "expected_grade", "tail_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, keep boolean, expected_grade double, tail_probability double")


def rate(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, fit(docs, labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")), **kw))
