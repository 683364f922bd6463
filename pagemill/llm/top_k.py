"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are made integers. Equal ones are one point with its smallest ids, one more than are asked for, so
that copies cost nothing. Points are dealt to shards by median splits of a bounded sample, and each shard
builds its tree once: median splits along the widest side, a tight box for every node, a leaf of few
points. The trees are kept in a table, one row for each shard.

A query searches the shard it falls into first. Its k-th best there goes with it to the other shards, but
only to those whose box can hold something better: the inner product with a box's best corner bounds what
is inside. In a tree nodes are opened best bound first, and the search ends when the next bound can't beat
the k-th best so far, with ties decided by the smallest id below a node. Tasks hold one tree and one block
of queries, so neither grows with the table. Samples only decide where points lie; results are exact.

Defined cases: vectors that are null or hold null or non-finite components and rows without vec_id take
no part; vectors of different lengths are not compared, empty ones have a score of 0 with each other; a
repeated row is another candidate with the same id, and each of the rows of an id that is asked is a query
with k rows of its own; ties go to the smaller vec_id; components beyond long saturate, as do scores; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import repeat, stored

_LONGS = pa.list_(pa.int64())
_FOUND = "query_id long, node long, copies long, dim int, home int, vec array<long>, scores array<long>, ids array<long>"
_NONE = (float("-inf"), 0)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where they hold every sum, else in integers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    kind = float if a.shape[1] * _largest(a) * _largest(b) < 1 << 53 else object
    return a.astype(kind) @ b.astype(kind).T


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have with a point of each box."""
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


class Tree:
    """A KD-tree over different integer vectors; `ids[first[i]:first[i + 1]]` are the ascending ids of point i."""

    _PARTS = ("x", "ids", "first", "low", "high", "start", "end", "right", "least")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, x: np.ndarray, ids: list[list[int]], leaf: int = 64) -> Tree:
        """Nodes in depth-first order: a node's first child follows it, its second is `right` (-1: a leaf)."""
        order, smallest = np.arange(len(x)), np.array([i[0] for i in ids], np.int64)
        low, high, start, end, right, least = [], [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own, node = x[order[a:b]], len(right)
            if parent >= 0:
                right[parent] = node
            low.append(own.min(0))
            high.append(own.max(0))
            start.append(a)
            end.append(b)
            right.append(-1)
            least.append(smallest[order[a:b]].min())
            if b - a > leaf:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(high[-1] - low[-1])], half)]
                todo += [(a + half, b, node), (a, a + half, -1)]
        first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])])
        flat = np.array([k for i in order for k in ids[i]], np.int64)
        return cls(x=x[order], ids=flat, first=first, low=np.array(low), high=np.array(high), start=np.array(start), end=np.array(end), right=np.array(right), least=np.array(least))

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self._PARTS})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as parts:
            return cls(**{k: parts[k] for k in cls._PARTS})

    def search(self, queries: np.ndarray, names: list[int], known: list[tuple], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best (score, -id), at most k and none that falls short of the one known, without the query's own row."""
        exact = self.x.shape[1] * _largest(self.x) * _largest(queries) < 1 << 53
        points = self.x.astype(float if exact else object)
        right, start, end, least = (getattr(self, c).tolist() for c in ("right", "start", "end", "least"))
        self.opened, out = 0, []
        for at in range(0, len(queries), 256):
            for q, name, kth, bound in zip(queries[at : at + 256], names[at : at + 256], known[at : at + 256], _bounds(queries[at : at + 256], self.low, self.high).tolist(), strict=True):
                best, heap, asked = [], [(-bound[0], least[0], 0)], q.astype(points.dtype)
                while heap:
                    up, smallest, node = heappop(heap)
                    if (-up, -smallest) < kth:
                        break
                    if right[node] >= 0:
                        for child in (node + 1, right[node]):
                            if (bound[child], -least[child]) >= kth:
                                heappush(heap, (-bound[child], least[child], child))
                        continue
                    self.opened += 1
                    scores = points[start[node] : end[node]] @ asked
                    for i in np.flatnonzero(scores >= kth[0]).tolist():
                        score, p, own = int(scores[i]), start[node] + i, True
                        for n in self.ids[self.first[p] : self.first[p + 1]].tolist():
                            if n == name and own and (self.x[p] == q).all():
                                own = False
                                continue
                            item = (score, -n)
                            if len(best) < k:
                                heappush(best, item)
                            elif item > best[0]:
                                heapreplace(best, item)
                            else:
                                break
                    if len(best) == k:
                        kth = max(kth, best[0])
                out.append(best)
        return out


def splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and values of 2^depth - 1 median splits, node n's children at 2n + 1 and 2n + 2."""
    side, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
    own = {0: sample}
    for n in range(len(side)):
        x = own.pop(n)
        if x.size:
            mid = np.partition(x, (len(x) - 1) // 2, 0)[(len(x) - 1) // 2]
            above = (x > mid).sum(0)
            wide = np.where(4 * above >= len(x), x.max(0) - x.min(0), -1)
            side[n] = np.argmax(wide) if wide.max() >= 0 else np.argmax(above)
            value[n] = mid[side[n]]
        right = x[:, side[n]] > value[n] if x.size else np.zeros(len(x), bool)
        own[2 * n + 1], own[2 * n + 2] = x[~right], x[right]
    return side, value


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _dealt(rows: DataFrame, cuts: dict[int, tuple[np.ndarray, np.ndarray]], depth: int) -> DataFrame:
    """rows with `home`, the shard that the splits of their length lead to; lengths that the sample doesn't know have one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in cuts and dim:
                    at = np.flatnonzero(dims == dim)
                    x, node, (side, value) = _matrix(batch.column("vec").take(pa.array(at)), dim), np.zeros(len(at), np.int64), cuts[dim]
                    for _ in range(depth):
                        node = 2 * node + 1 + (x[np.arange(len(x)), side[node]] > value[node])
                    home[at] = node - ((1 << depth) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])

    return rows.mapInArrow(run, rows.withColumn("home", F.lit(0)).schema)


def _grown(key: tuple, points: pa.Table) -> pa.Table:
    """One shard's tree and box."""
    dim = key[0].as_py()
    tree = Tree.build(_matrix(points.column("vec"), dim), points.column("ids").to_pylist())
    box = [pa.array([x[0].tolist()], _LONGS) for x in (tree.low, tree.high)]
    return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *box, pa.array([tree.saved()], pa.binary())], ["dim", "shard", "low", "high", "tree"])


def _searched(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """asked: queries with (dim, shard, block) and the k-th best known, if any. What each finds in its shard."""

    def run(key: tuple, tree: pa.Table, queries: pa.Table) -> pa.Table:
        q, names = _matrix(queries.column("vec"), key[0].as_py()), queries.column("query_id").to_pylist()
        known = [_NONE if s is None else (s, -i) for s, i in zip(queries.column("kth").to_pylist(), queries.column("kth_id").to_pylist(), strict=True)]
        found = Tree.loaded(tree.column("tree")[0].as_py()).search(q, names, known, k)
        limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        lists = [pa.array([[f(x) for x in best] for best in found], _LONGS) for f in (lambda x: limit(x[0]), lambda x: -x[1])]
        kept = [queries.column(c) for c in ("query_id", "node", "copies", "dim", "home", "vec")]
        return pa.table([*kept, *lists], [*(c.split()[0] for c in _FOUND.split(", "))])

    keys = ["dim", "shard", "block"]
    wanted = asked.select(*keys).distinct()
    held = trees.select("dim", "shard", "tree").join(wanted, keys[:2]).select(*(F.col(c).alias(f"tree_{c}") for c in keys), "tree")
    return held.groupBy(*(f"tree_{c}" for c in keys)).cogroup(asked.groupBy(*keys)).applyInArrow(lambda key, a, b: run(key, a, b), _FOUND)


def _onward(found: DataFrame, boxes: list, shift: int, k: int, blocks: int) -> DataFrame:
    """Queries with the k-th best known, once for each other shard that can hold something better."""
    by_dim: dict[int, dict[int, list]] = {}
    for dim, shard, low, high in boxes:
        by_dim.setdefault(dim, {}).setdefault(shard >> shift, []).append((shard, low, high))
    known = {dim: (np.array([np.min([b[1] for b in g], 0) for g in groups.values()]), np.array([np.max([b[2] for b in g], 0) for g in groups.values()]), [[b[0] for b in g] for g in groups.values()]) for dim, groups in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, homes, scores, ids = (batch.column(c).to_pylist() for c in ("dim", "home", "scores", "ids"))
            at, shards, kth, kth_id = [], [], [], []
            for dim in set(dims):
                rows = [i for i, d in enumerate(dims) if d == dim]
                low, high, members = known[dim]
                bounds = _bounds(_matrix(batch.column("vec").take(pa.array(rows)), dim), low.reshape(len(low), dim), high.reshape(len(high), dim))
                for i, bound in zip(rows, bounds.tolist(), strict=True):
                    worst = min(zip(scores[i], (-x for x in ids[i]), strict=True)) if len(ids[i]) == k else None
                    to = [s for b, m in zip(bound, members, strict=True) if worst is None or b >= worst[0] for s in m if s != homes[i]]
                    at += [i] * len(to)
                    shards += to
                    kth += [worst and worst[0]] * len(to)
                    kth_id += [worst and -worst[1]] * len(to)
            kept = batch.select(["query_id", "node", "copies", "dim", "home", "vec"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shards, pa.int32()), pa.array(kth, pa.int64()), pa.array(kth_id, pa.int64())], [*kept.schema.names, "shard", "kth", "kth_id"])

    ends = "query_id long, node long, copies long, dim int, home int, vec array<long>, shard int, kth long, kth_id long"
    return found.mapInArrow(run, ends).withColumn("block", F.pmod("node", F.lit(blocks)))


def points_of(table: DataFrame, scale: int = 64) -> DataFrame:
    """Rows (vec_id, vec, dim) of the usable vectors, as integers."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("vec"), F.size("embedding").alias("dim"))


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_bytes: int = 64 << 20, min_shards: int = 8, sample: int = 4096, block: int = 8192, box_bytes: int = 64 << 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k others of the highest inner product.

    A shard has about `shard_bytes` of points, a task one shard and about `block` queries. The boxes that
    are sent to all tasks take `box_bytes` at most: beyond, boxes of shards side by side are put together.
    """
    rows = points_of(table, scale)
    order = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    copies = rows.withColumn("nth", order).where(F.col("nth") <= k + 1).groupBy("vec", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(copies)
    bytes_, widest = points.agg(F.coalesce(F.sum(8 * (F.size("vec") + F.size("ids")).cast("long")), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0))).first()
    depth = max(min_shards - 1, -(-bytes_ // shard_bytes) - 1).bit_length()
    seen: dict[int, list] = {}
    for r in points.select("vec", "dim").orderBy(F.xxhash64("vec"), "vec").limit(sample).collect():
        seen.setdefault(r["dim"], []).append(r["vec"])
    cuts = {dim: splits(np.array(x, np.int64).reshape(len(x), dim), depth) for dim, x in seen.items()}
    dealt = _dealt(points, cuts, depth).withColumnRenamed("home", "shard")
    trees = stored(dealt.groupBy("dim", "shard").applyInArrow(_grown, "dim int, shard int, low array<long>, high array<long>, tree binary"))

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id"), "vec", "dim").agg(F.count(F.lit(1)).alias("copies"))
    nothing = F.lit(None).cast("long")
    home = _dealt(queries.withColumn("node", F.xxhash64("vec")), cuts, depth).select("*", F.col("home").alias("shard"), F.lit(0).alias("block"), nothing.alias("kth"), nothing.alias("kth_id"))
    first = stored(_searched(home, trees, k))
    shift = max(0, ((16 * widest << depth) // box_bytes).bit_length())
    blocks = -(-first.count() // block) or 1
    rest = _searched(_onward(first, trees.select("dim", "shard", "low", "high").collect(), shift, k, blocks), trees, k)

    found = first.unionByName(rest).select("query_id", "node", "copies", F.explode(F.arrays_zip("scores", "ids")).alias("f")).select("query_id", "node", "copies", F.col("f.scores").alias("score"), F.col("f.ids").alias("vec_id"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return repeat(best, "copies").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
