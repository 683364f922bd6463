"""How far sources diverge in their words, within each language: all pairs of sources by tiles of groups, and the words that set a source apart.

A group is a (lang, source). Terms that enough documents of a language hold are its vocabulary, dealt to
chunks. A group's counts are packed into one row for each chunk (places and counts). Groups are dealt to
blocks; a tile is a pair of blocks, and each packed row is sent to all tiles of its block. A tile's task
reads its rows chunk by chunk and adds every pair's divergence over the chunk to the tile's matrix, in both
directions, so it holds one chunk of two blocks at a time. Terms that no group of a tile has in a chunk are
alike for all and are added once by their number. Probabilities are integers in thousand-millionths, by long
division; all sums are integers.

Counting runs over texts once: words and documents are tallied in each task, then by (lang, source, term).
A term's row can't be hot, as it has one row for each task before the shuffle at most; a group with most
rows has one row for each of its terms, and its highest 200 terms are first sought where they are.

Defined cases: null text, lang and source count as empty; a text without terms still makes its group
occur; a repeated row is another document; a language without vocabulary has pairs with value 0; ties go
to the smaller item in UTF-8; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall
GROUP = ["lang", "source"]


def tallied(documents: DataFrame, most: int = 800_000) -> DataFrame:
    """Rows (lang, source, term, n, docs), several for a term, and one or more with a null term for every group; a task holds about `most` terms before it writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        names = ["lang", "source", "term", "n", "docs"]

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms, rows = list(n), len(n) + 1
                longs = [pa.concat_arrays([pa.array([0], pa.int64()), pa.array(x, pa.int64(), size=rows - 1)]) for x in (n.values(), map(docs.__getitem__, terms))]
                said = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), rows), pa.repeat(pa.scalar(source, pa.string()), rows), said, *longs], names)
            counts.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(n), _TERMS(text.as_buffer().to_pybytes().lower())
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held > most:
                    yield from flushed()
                    held = 0
        yield from flushed()

    return documents.select(*(text_or_empty(c).cast("string").alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column | str, total: Column | str) -> Column:
    """1 + floor(10^9 * (count + 1) / total), three digits at a time, so that no product leaves long."""
    left, out = F.col(count) + 1 if isinstance(count, str) else count + 1, F.lit(0).cast("long")
    total = F.col(total) if isinstance(total, str) else total
    for _ in range(3):
        whole = F.call_function("div", left * 1000, total)
        left, out = left * 1000 - whole * total, out * 1000 + whole
    return out + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for a matrix of groups by terms."""
    left, total, out = counts + 1, totals[:, None], np.zeros_like(counts)
    for _ in range(3):
        left = left * 1000
        whole = left // total
        left, out = left - whole * total, out * 1000 + whole
    return out + 1


class Vocabulary:
    """Groups, kept terms and counts of a table, stored.

    `groups`: (lang, source, v, total, lang_total, block, blocks), where v is the size of the language's vocabulary,
    and totals have it added; `cells`: (lang, source, term, n, lang_n, chunk, place) for each kept term that a group has.
    """

    def __init__(self, documents: DataFrame, least_docs: int = 3, block: int = 16, chunk: int = 4096):
        counts = stored(tallied(documents).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        terms = counts.where("term IS NOT NULL")
        kept = stored(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        # Chunks are as many as all terms ask for, so that terms are never dealt by their language.
        at = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-kept.count() // chunk))))
        placed = kept.select("*", at.alias("chunk")).withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        self.cells = stored(terms.select(*GROUP, "term", "n").join(placed, ["lang", "term"]))
        occurring = counts.where("term IS NULL").select(*GROUP)
        sums = self.cells.groupBy(*GROUP).agg(F.sum("n").alias("n"))
        blocks = occurring.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        every = occurring.join(sums, GROUP, "left").join(langs, "lang", "left").join(blocks, "lang")
        self.groups = stored(every.select(*GROUP, zero("v").alias("v"), (zero("n") + zero("v")).alias("total"), (zero("lang_total") + zero("v")).alias("lang_total"), F.pmod(F.xxhash64("source"), "blocks").alias("block"), "blocks"))

    def packed(self) -> DataFrame:
        """Rows (lang, source, chunk, places, counts)."""
        both = self.cells.groupBy(*GROUP, "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("both"))
        return both.select(*GROUP, "chunk", F.col("both.place").alias("places"), F.col("both.n").alias("counts"))


class _Tile:
    """Two blocks of groups and what their pairs amount to so far."""

    def __init__(self, key: tuple):
        self.key, self.sides, self.v, self.covered, self.open, self.rows = key, ({}, {}), 0, 0, False, []

    def begin(self) -> None:
        self.totals = [np.array([t for _, t in side.values()], np.int64) for side in self.sides]
        self.there = np.zeros((len(self.sides[0]), len(self.sides[1])), np.int64)
        self.back, self.open = np.zeros_like(self.there), True

    def head(self, block: int, source: str, total: int, v: int) -> None:
        for k, side in enumerate(self.sides):
            if block == self.key[1 + k]:
                side[source] = (len(side), total)
        self.v = v

    def add(self, p: np.ndarray, q: np.ndarray, times: int = 1) -> None:
        for a in range(len(p)):
            square = (p[a] - q) ** 2
            self.there[a] += times * (square // q).sum(1)
            self.back[a] += times * (square // p[a]).sum(1)

    def chunk(self) -> None:
        """Adds the rows held, all of one chunk."""
        if not self.open:
            self.begin()
        if not self.rows:
            return
        places = np.unique(np.concatenate([p for *_, p, _ in self.rows]))
        both = []
        for k, side in enumerate(self.sides):
            counts = np.zeros((len(side), len(places)), np.int64)
            for block, source, at, n in self.rows:
                if block == self.key[1 + k]:
                    counts[side[source][0], np.searchsorted(places, at)] = n
            both.append(shares(counts, self.totals[k]))
        self.add(*both)
        self.covered += len(places)
        self.rows = []

    def done(self) -> pa.RecordBatch:
        self.chunk()
        if self.v > self.covered:
            self.add(*(shares(np.zeros((len(t), 1), np.int64), t) for t in self.totals), self.v - self.covered)
        out = [(self.key[0], a, b, int(self.there[i, j])) for a, (i, _) in self.sides[0].items() for b, (j, _) in self.sides[1].items() if a != b]
        if self.key[1] != self.key[2]:
            out += [(self.key[0], b, a, int(self.back[i, j])) for a, (i, _) in self.sides[0].items() for b, (j, _) in self.sides[1].items()]
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 3 else pa.int64()) for k, c in enumerate(cols)], ["lang", "source", "item", "value"])


def pairs(words: Vocabulary) -> DataFrame:
    """Rows (lang, source, item, value): how far each source is from each other one of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now = None, None
        for batch in batches:
            lists = batch.column("places"), batch.column("counts")
            for k, r in enumerate(batch.drop_columns(["places", "counts"]).to_pylist()):
                key = (r["lang"], r["one"], r["two"])
                if tile is None or key != tile.key:
                    if tile is not None:
                        yield tile.done()
                    tile, now = _Tile(key), -1
                if r["chunk"] < 0:
                    tile.head(r["block"], r["source"], r["total"], r["v"])
                    continue
                if r["chunk"] != now:
                    tile.chunk()
                    now = r["chunk"]
                tile.rows.append((r["block"], r["source"], *(x[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)))
        if tile is not None:
            yield tile.done()

    none = F.array().cast("array<int>"), F.array().cast("array<long>")
    heads = words.groups.select(*GROUP, F.lit(-1).cast("long").alias("chunk"), none[0].alias("places"), none[1].alias("counts"), "v", "total", "block", "blocks")
    rows = heads.unionByName(words.packed().join(words.groups.drop("lang_total"), GROUP))
    with_all = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = with_all.select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).drop("other", "blocks")
    key = ["lang", "one", "two"]
    return tiles.repartition(*key).sortWithinPartitions(*key, "chunk", "block", "source").mapInArrow(run, "lang string, source string, item string, value long")


def telling(words: Vocabulary) -> DataFrame:
    """Rows (lang, source, item, value): terms that a source has more often than its language, and by how much."""
    known = words.cells.join(words.groups, GROUP).select(*GROUP, F.col("term").alias("item"), share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))
    return known.where("p > q").select(*GROUP, "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))


def audit(documents: DataFrame, least_docs: int = 3, most_terms: int = 200, block: int = 16, chunk: int = 4096) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for sources, `term` for a source's telling terms."""
    words = Vocabulary(documents, least_docs, block, chunk)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    terms = telling(words).withColumn("rank", rank).where(F.col("rank") <= most_terms)
    both = pairs(words).withColumns({"rank": rank, "part": F.lit("pair")}).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select(*GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank"))
