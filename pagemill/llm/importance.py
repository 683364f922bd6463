"""Importance resampling towards a target: hashed n-gram counts as sparse matrices, drawn by Gumbel top-k.

Texts of both tables become a document-by-bucket count matrix, kept as blocks of compressed sparse rows
in a stored table: a block is one row with the ids of its documents, where each document's entries begin,
and packed buckets and counts. Column sums of the blocks give the two distributions; their logarithmic
ratio is the gain of a bucket; a sparse matrix-vector product of each block with the gains gives the
documents' weights. With Gumbel noise from a hash of the id the highest scores are a draw without
replacement in proportion to the exponential of the weights. Texts are read once; later passes read blocks.

A word's checksum is carried on to the two words after it, so each feature costs one step over its last
word. Ranks are given by ranges of scores: rows are dealt by range, counted in each range, and numbered
within it, so no task orders all rows. Only column sums (one for each of `buckets`) and the ranges' sizes
reach the driver.

Defined cases: null and empty texts have no features and a weight of 0; a null doc_id is written as the
empty text under the hash and follows all ids among ties; a repeated row is another document with the
same id, scored and drawn on its own; rows equal in all columns may change places; other columns are not
read; an empty table gives an empty result, an empty target counts as no features there.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
BLOCKS = "docs array<long>, words array<long>, starts array<long>, buckets binary, counts binary"
SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def hashed(text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text in UTF-8, and the buckets of its runs of one to three words."""
    words = _WORDS(text.lower())
    after = [b" " + w for w in words]
    one = list(map(crc32, words))
    two = list(map(crc32, after[1:], one))
    return len(words), np.array(one + two + list(map(crc32, after[2:], two)), np.int64) % buckets


def count_matrix(rows: DataFrame, buckets: int = 10_000, block_entries: int = 1 << 11) -> DataFrame:
    """rows: (doc_id, text). Blocks of compressed sparse rows, each of about `block_entries` entries at most, or one document.

    Spark reads 4096 blocks of a stored table at once, so a task holds 4096 times a block: of 12 KB here.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed in two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, starts, at, n = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            packed = [np.concatenate(x).astype(kind).tobytes() for x, kind in ((at, "<u2"), (n, "<u4"))]
            longs = [pa.array([x], pa.list_(pa.int64())) for x in (docs, words, starts)]
            return pa.RecordBatch.from_arrays([*longs, *(pa.array([x], pa.binary()) for x in packed)], ["docs", "words", "starts", "buckets", "counts"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                many, found = hashed(text.as_buffer().to_pybytes() if text.is_valid else b"", buckets)
                entries, often = np.unique(found, return_counts=True)
                docs.append(doc)
                words.append(many)
                starts.append(starts[-1] + len(entries))
                at.append(entries)
                n.append(often)
                if starts[-1] >= block_entries:
                    yield block()
                    docs, words, starts, at, n = [], [], [0], [], []
        if docs:
            yield block()

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        r = batch.slice(k, 1).to_pylist()[0]
        yield r["docs"], r["words"], np.array(r["starts"]), np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u4").astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = 10_000) -> list[int]:
    """How often each bucket occurs in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, at, n in _entries(batch):
                total += np.bincount(at, n, buckets).astype(np.int64)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    sums = [0] * buckets
    for bucket, n in blocks.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """The thousandfold logarithm of each bucket's smoothed share in the target over that in the source, rounded down."""
    every, aim, b = float(sum(source) + len(source)), float(sum(target) + len(target)), range(len(source))
    return np.array([math.floor(1000 * math.log((target[k] + 1.0) * every / ((source[k] + 1.0) * aim))) for k in b], np.int64)


def noise(doc: int | None, seed: int = 42) -> int:
    """Gumbel noise in thousandths, rounded down, from the hash of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(blocks: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """Each document's weight: the product of its row with the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, words, starts, at, n in _entries(batch):
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, n * gain[at])]
                features, weight = (x[starts[1:]] - x[starts[:-1]] for x in sums)
                score = weight + np.array([noise(doc, seed) for doc in docs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, features, words, weight, score)], ["doc_id", "n_features", "n_words", "weight", "score"])

    return blocks.mapInArrow(run, SCORED)


def drawn(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored with `rank`: 1 and on for that percentage of the documents of enough words with the highest scores, null for the others."""
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = stored(scored.where(able).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = sorted(dealt.groupBy("part").count().collect())
    take, before, starts = percent * sum(n for _, n in sizes) // 100, 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    # One row for each partition of the shuffle.
    start = scored.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    ranked = dealt.join(F.broadcast(start), "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return ranked.drop("part", "start").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """documents: (doc_id, text), target: (text). Rows (doc_id, n_features, n_words, weight, score, rank) for each document."""
    blocks = stored(count_matrix(documents, buckets))
    aim = count_matrix(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    return drawn(stored(weighted(blocks, gain, seed)), percent, least_words)
