"""SimHash near-duplicates: a byte-position inverted index with count filtering, verified, as exact components.

Fingerprints are 64 bits over hashed word shingles. Two that differ in at most three bits share at
least five of their eight bytes in place. The index posts every different fingerprint under each set
of four byte positions whose numbers XOR to zero together with its bytes there. Those 14 sets hold
every three positions in exactly one complement, so any five shared bytes contain one of the sets:
no link is missed. Inside a posting list the shared bytes of a pair are tallied, pairs with fewer
than five are dropped, the rest verified by their differing bits.

Only components are wanted, so a list answers with a star for each of its local components, a row
for each member at most. Exact copies are one fingerprint. Lists longer than `block` are dealt as
pairs of blocks to different tasks; no list is ever collected whole or cut short.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer than three
words are one shingle; rows without a doc_id get a fingerprint and the component of that fingerprint
(null if no document of it has an id); repeated rows stay; only the id and text columns are read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, checkpointed, components, text_or_empty

SEED = 42
SETS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PIECE = 50_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text, unsigned. Only A-Z are lower-cased; long texts are hashed piece by piece."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    n = len(words) - width + 1
    counts = np.zeros(2048, np.int64)
    for at in range(0, n, _PIECE):
        own = words[at : at + _PIECE + width - 1]
        joined = b" ".join(own)
        ends = np.cumsum([len(w) + 1 for w in own]) - 1
        starts = np.concatenate([[0], ends[: len(own) - width] + 1]).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, text_hash, fp): fp the fingerprint's 64 bits as a long, text_hash a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def local_stars(lists: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the local components of each list. lists: the list number of each member, sorted.

    Members are compared with the next, the second next and so on; a list that is through drops out.
    """
    need = 8 - bits
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    here, step = np.arange(len(fps)), 1
    while len(here := here[here < len(fps) - step]) and len(here := here[lists[here] == lists[here + step]]):
        other = here + step
        x = fps[here] ^ fps[other]
        # The count filter first; only pairs that share enough bytes in place are verified.
        near = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= need)
        near = near[(np.bitwise_count(x[near]) <= bits) & (parent[here[near]] != parent[other[near]])]
        if len(near):
            for i, j in zip(here[near].tolist(), other[near].tolist(), strict=True):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
        step += 1
    moved = parent != np.arange(len(fps))
    return fps[moved], fps[parent[moved]]


def links(fps: DataFrame, bits: int = 3, block: int = 2048) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different fingerprints (column fp) with at most `bits` differing bits, up to 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees links of at most three differing bits")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    post = lambda k, s: F.struct(F.lit(k).alias("set"), sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(0).cast("long")).alias("bytes"))
    postings = fps.select("fp", F.inline(F.array(*(post(k, s) for k, s in enumerate(SETS)))))
    long_lists = checkpointed(postings.groupBy("set", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = postings.join(long_lists, ["set", "bytes"], "left").select("set", "bytes", "fp", F.inline(F.when(F.col("blocks").isNull(), one).otherwise(others)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            key = np.stack([t.column(c).to_numpy() for c in ("set", "bytes", "i", "j")], 1) if t.num_rows else np.empty((0, 4))
            new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if not len(new):
                rest = t
                continue
            yield stars(t.slice(0, new[-1]), key[: new[-1]])
            rest = t.slice(new[-1])
        if rest is not None and rest.num_rows:
            yield stars(rest, np.stack([rest.column(c).to_numpy() for c in ("set", "bytes", "i", "j")], 1))

    def stars(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        lists = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
        a, b = local_stars(lists, t.column("fp").to_numpy().view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    by = ("set", "bytes", "i", "j")
    return dealt.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3, block: int = 2048) -> DataFrame:
    """Rows (doc_id, text_hash, fp, component_id, first): each document, its fingerprint, the smallest doc_id reachable by links,
    and the component's first document (doc_id, text_hash)."""
    by_doc = checkpointed(fingerprints(docs, id_col, text_col, width))
    each = by_doc.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    roots = components(links(each, bits, block)).withColumnRenamed("node", "fp")
    rooted = checkpointed(each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    first = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("first")))
    named = checkpointed(rooted.select("fp", "root", "copies").join(first, "root").select("fp", "first", "copies"))
    return attached(by_doc, named, "fp", "copies").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **kw) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; of rows that repeat it, the least."""
    firsts = near_duplicates(docs, **kw).select("first").distinct().select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    own = F.xxhash64(text_or_empty("text")).alias("__own")
    there = docs.select("*", own).join(checkpointed(firsts), same, "left_semi")
    repeated = checkpointed(docs.groupBy(F.col("doc_id").alias("__id"), own.alias("__hash")).count().where("count > 1").select("__id", "__hash"))
    once = there.join(repeated, same, "left_anti").select(*docs.columns)
    again = there.join(repeated, same, "left_semi").groupBy("doc_id", "__own").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("w")).select("w.*")
    return once.unionByName(again)
