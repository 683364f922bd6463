"""Mixing sources to target weights by drawing fixed-length blocks of words.

Every source is one stream of its documents' words, cut into blocks of a fixed length. Each output
shard draws its number of slots from every source; a source's slots are numbered through all shards,
and slot j takes the block at place j of the source's pseudorandom index permutation (a new one for
each pass over the source). Blocks and slots are joined by source and index.

The shards' counts are multinomial draws given the sources' totals: a binary tree over the shards
splits the totals by draws without replacement, seeded by the node, so each shard finds its own
counts and first slots by one walk from the root, and all shards together take each total exactly.
A draw is exact at any size: every slot is taken by a coin, then as many as are too many or too few
are put back or taken, each slot as likely as any other.

Prefix sums give each document its place: a source is dealt by hash to groups, sums of groups are run up
per source, then places inside a group, so a hot source never meets in one task. There are four times as
many groups as the root of the largest source's documents, which keeps groups and their number small.
The driver holds one row for each source, at most `max_sources`; more is an error.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, the
last; repeated rows have places of their own; ties go by doc_id and a hash of the text; only
doc_id, text and source are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
_WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The target of each source: shares by weight, stopped at `most` times the size, the excess shared anew until none is above."""
    size = np.array(sizes, float)
    weight = np.resize(np.array(weights, float), len(size))
    out, open_, left = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while open_.any():
        part = left * weight / weight[open_].sum()
        over = open_ & (part > most * size)
        if not over.any():
            out[open_] = part[open_]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(index: np.ndarray, n: int, seed: int | list[int]) -> np.ndarray:
    """Places 0 to n-1 to a pseudorandom permutation of them: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    keys = [np.uint64(k) for k in np.random.default_rng(seed).integers(1, 1 << 63, 4)]
    while todo.any():
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def drawn(rng: np.random.Generator, counts: np.ndarray, m: int) -> np.ndarray:
    """How many of each kind are among m things drawn without replacement; exact for any counts.

    Things are taken by coins of probability m / n. The surplus, about the root of n, is put back (what lacks is
    taken): different places in the line of all things taken (left), which makes all sets of m equally likely.
    """
    n = int(counts.sum())
    if not n:
        return np.zeros_like(counts)
    taken = rng.binomial(counts, m / n)
    over = int(taken.sum()) - m
    pool = taken if over > 0 else counts - taken
    places = np.zeros(0, np.int64)
    while len(places) < abs(over):
        places = np.concatenate([places, rng.integers(0, int(pool.sum()), abs(over) - len(places))])
        _, first = np.unique(places, return_index=True)
        places = places[np.sort(first)]
    moved = np.bincount(np.searchsorted(np.cumsum(pool), places, "right"), minlength=len(counts))
    return taken - moved if over > 0 else taken + moved


def shard_slots(shard: int, shards: int, totals: np.ndarray, slots: int, seed: int, nodes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots that a shard takes of each source; `slots` a shard, the last takes the rest. nodes: keeps the draws of the path to the last shard."""
    lo, hi, first, own = 0, shards, np.zeros(len(totals), np.int64), totals.astype(np.int64)
    everything = int(own.sum())
    nodes = {} if nodes is None else nodes
    for k in [k for k in nodes if not k[0] <= shard < k[1]]:
        del nodes[k]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in nodes:
            nodes[lo, hi] = drawn(np.random.default_rng([seed, lo, hi]), own, min(mid * slots, everything) - lo * slots)
        left = nodes[lo, hi]
        if shard < mid:
            hi, own = mid, left
        else:
            lo, first, own = mid, first + left, own - left
    return first, own


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, text_hash, source, size)."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


class Mix:
    """The draw of one mix; `takes` has a row for each document, `blocks` one for each part of it in a block."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, shard: int = 16_384, chunks: int | None = None, max_sources: int = 100_000, seed: int = 7, **columns: str):
        spark = docs.sparkSession
        self.documents = checkpointed(sized(docs, **columns))
        found = self.documents.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"over {max_sources} sources")
        found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
        goal = targets([r.n for r in found], weights, share, most)
        blocks = np.array([-(-r.n // block) for r in found], np.int64)
        quota = np.array([min(most * b, round(t * b / r.n)) if r.n else 0 for r, t, b in zip(found, goal, blocks.tolist(), strict=True)], np.int64)
        rows = [(k, r.source, r.n, t) for k, (r, t) in enumerate(zip(found, goal, strict=True))]
        self.sources = spark.createDataFrame(rows, "number int, source string, source_size long, target double")
        self.slots = self._slots(spark, quota, blocks, shard, seed)
        self.blocks = self._blocks(block, chunks or 4 * math.isqrt(max((r.rows for r in found), default=1)) + 1)

    @staticmethod
    def _slots(spark, quota: np.ndarray, blocks: np.ndarray, shard: int, seed: int) -> DataFrame:
        """Rows (number, block, times)."""
        shards = max(1, -(-int(quota.sum()) // shard))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes: dict = {}
            for b in batches:
                for k in b["id"].tolist():
                    first, own = shard_slots(k, shards, quota, shard, seed, nodes)
                    for s in np.flatnonzero(own).tolist():
                        j = np.arange(first[s], first[s] + own[s])
                        for turn in np.unique(j // blocks[s]).tolist():
                            at = permuted(j[j // blocks[s] == turn] % blocks[s], int(blocks[s]), [seed, s, turn])
                            yield pd.DataFrame({"number": np.full(len(at), s, np.int32), "block": at})

        drawn = spark.range(0, shards, 1, min(shards, max(1, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "number int, block long")
        # Spark takes a table made from a few shard numbers for a small one: the hint keeps it from being broadcast.
        return drawn.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")

    def _blocks(self, block: int, chunks: int) -> DataFrame:
        """Rows (number, block, doc_id, text_hash, place, size, first, words): words of the document in the block, from its word `first` on."""
        numbered = self.documents.join(F.broadcast(self.sources.select("number", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).select("number", "doc_id", "text_hash", "size", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)).alias("chunk")).where("size > 0")
        sums = numbered.groupBy("number", "chunk").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("number", "chunk").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = numbered.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["number", "chunk"]).withColumn("place", F.col("start") + F.col("at"))
        cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))))
        a, z = F.greatest(F.col("place"), F.col("block") * block), F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block)
        return cut.select("number", "block", "doc_id", "text_hash", "place", "size", (a - F.col("place")).alias("first"), (z - a).alias("words"))

    def takes(self) -> DataFrame:
        """Rows (doc_id, size, source_size, target, taken)."""
        drawn = self.blocks.join(self.slots, ["number", "block"]).groupBy("number", "doc_id", "text_hash", "place", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        # A document's drawn parts, or none: its own row adds nothing to the sum, so no join is needed.
        undrawn = self.blocks.where("first = 0").select("number", "doc_id", "text_hash", "place", "size", F.lit(0).cast("long").alias("taken"))
        per = drawn.unionByName(undrawn).groupBy("number", "doc_id", "text_hash", "place", "size").agg(F.sum("taken").alias("taken"))
        named = per.join(F.broadcast(self.sources), "number").select("doc_id", "size", "source_size", "target", "taken")
        empty = self.documents.where("size = 0").join(F.broadcast(self.sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        return named.unionByName(empty)


def cut_out(text: str, parts: list[tuple[int, int]]) -> str:
    """The stretches of text that hold the given runs of words (first, number), in order; all words: the text itself."""
    spans = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for first, words in sorted(parts):
        if runs and runs[-1][1] == first:
            runs[-1][1] += words
        else:
            runs.append([first, first + words])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in runs)


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents: for each turn in which words of a document were drawn, its row with the text of those words. Columns stay."""
    mix = Mix(docs, **kw)
    part = F.struct("first", "words", "times")
    drawn = mix.blocks.join(mix.slots, ["number", "block"]).groupBy("number", "doc_id", "text_hash", "place").agg(F.collect_list(part).alias("__parts"))
    # Rows that repeat a document hold the same text: the first of their places goes with the first of the rows.
    order = Window.partitionBy("__id", "__hash").orderBy("place")
    drawn = drawn.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "place", "__parts").select("__id", "__hash", "__parts", F.row_number().over(order).alias("__copy"))
    own = docs.select("*", F.xxhash64(text_or_empty("text")).alias("__own"), F.col("source").alias("__source"))
    there = own.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy(F.col("source").asc_nulls_last())))
    joined = there.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")) & (F.col("__nth") == F.col("__copy")))

    @F.pandas_udf("array<string>")
    def turns(text: pd.Series, parts: pd.Series) -> pd.Series:
        def one(t: str, ps) -> list[str]:
            most = max(p["times"] for p in ps)
            return [cut_out(t, [(p["first"], p["words"]) for p in ps if p["times"] >= k]) for k in range(1, most + 1)]

        return pd.Series([one(t, ps) for t, ps in zip(text, parts, strict=True)])

    return joined.withColumn("text", F.explode(turns("text", "__parts"))).select(*docs.columns)
