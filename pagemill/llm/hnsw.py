"""Near-duplicate embeddings over hierarchical navigable small-world graphs, one per shard.

Different vectors are dealt to shards; every shard builds a graph of its own and is queried with all
vectors, which stream past it, so a task holds one shard and one batch. Searches run for many
queries at once. A query whose beam is full of links is searched again with a wider one; and
each batch is audited: some queries, those with links first, are held against every vector of the
shard, and where recall falls short the beam of the shard doubles and the batch is searched anew.
What is linked is decided by the cosine in double precision. The links that audits found, of those
that are there, are summed over all shards: every row of the result says this recall, and a run
that falls below 0.9 in the end is an error.

Equal vectors are one node with a multiplicity, so copies cost nothing. A query answers with the
number of its links and one edge for each component of the shard that it touches, never with
pairs. Edges of all shards together give the components.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components have no
links and are components of their own; vectors of different lengths have no links; a repeated row is
another vector with the same id; ties don't matter, since all links count; a null vec_id takes part,
but is no component's name unless nothing else is; nodes are known by a 64-bit hash of the vector;
only vec_id and embedding are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, checkpointed, components

_NEAR = 1e-4  # single precision is that close to double at least


class Graph:
    """A hierarchical navigable small-world graph over unit vectors (rows of single precision).

    The order of insertion is a pseudorandom one in which level k holds the first n / m^k vectors, so
    a position means the same on every level. Levels are built from the top, each in batches.
    """

    def __init__(self, vectors: np.ndarray, m: int = 16, build_beam: int = 48, seed: int = 3):
        self.order = np.random.default_rng(seed).permutation(len(vectors))
        self.x, self.m, self.build_beam = np.ascontiguousarray(vectors[self.order], np.float32), m, build_beam
        sizes = [len(vectors)]
        while sizes[-1] > 4 * m:
            sizes.append(-(-sizes[-1] // m))
        self.levels: list[np.ndarray] = []  # of neighbours, the top level first
        for k, n in reversed(list(enumerate(sizes))):
            self._build(n, m if k else 2 * m)

    def _build(self, n: int, width: int) -> None:
        upper = len(self.levels[-1]) if self.levels else 0
        near = np.full((n, width), -1, np.int32)
        at = min(n, 4 * self.m)
        self._link(near, 0, at, np.zeros((at, 0), np.int32), np.zeros((at, 0), np.float32))
        while at < n:
            end = min(n, at + min(at, 1024), upper if at < upper else n)
            q = self.x[at:end]
            entry = self._descend(q) if at >= upper and upper else np.zeros((len(q), 1), np.int32)
            found, sims = self._search(near[:at], q, entry, self.build_beam)
            self._link(near, at, end, found, sims)
            at = end
        self.levels.append(near)

    def _link(self, near: np.ndarray, a: int, b: int, found: np.ndarray, sims: np.ndarray) -> None:
        """Gives the new vectors a to b their neighbours among those found and each other, and those the way back."""
        q = self.x[a:b]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(self.build_beam, len(q))
        pick = np.argpartition(-own, k - 1, 1)[:, :k]
        ids = np.concatenate([found, pick + a], 1)
        sims = np.concatenate([sims, np.take_along_axis(own, pick, 1)], 1)
        ids[~np.isfinite(sims)] = -1
        near[a:b] = self._choose(ids, sims, near.shape[1])
        to, frm = near[a:b].ravel(), np.repeat(np.arange(a, b), near.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        sim = np.einsum("id,id->i", self.x[to], self.x[frm])
        s = np.lexsort((-sim, to))
        to, frm, sim = to[s], frm[s], sim[s]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        keep = rank < near.shape[1]
        more = np.full((len(nodes), near.shape[1]), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = frm[keep]
        for i in range(0, len(nodes), 512):
            own_nodes = nodes[i : i + 512]
            ids = np.concatenate([near[own_nodes], more[i : i + 512]], 1)
            ids = np.sort(ids, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("ikd,id->ik", self.x[ids], self.x[own_nodes])
            near[own_nodes] = self._choose(ids, np.where(ids < 0, -np.inf, sims), near.shape[1])

    def _choose(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates, those nearer to it than to any chosen before; then the nearest of the rest."""
        out = np.full((len(ids), width), -1, np.int32)
        for i in range(0, len(ids), 256):
            order = np.argsort(-sims[i : i + 256], 1, kind="stable")[:, : 2 * width]
            cand, sim = np.take_along_axis(ids[i : i + 256], order, 1), np.take_along_axis(sims[i : i + 256], order, 1)
            v = self.x[cand]
            among = v @ v.transpose(0, 2, 1)
            taken, nearest = np.zeros(cand.shape, bool), np.full(cand.shape, -np.inf, np.float32)
            for j in range(cand.shape[1]):
                ok = (cand[:, j] >= 0) & (nearest[:, j] < sim[:, j]) & (taken.sum(1) < width)
                taken[:, j] = ok
                nearest = np.where(ok[:, None], np.maximum(nearest, among[:, :, j]), nearest)
            best = np.argsort(np.where(cand < 0, 2, ~taken), 1, kind="stable")[:, :width]
            out[i : i + 256, : best.shape[1]] = np.take_along_axis(cand, best, 1)
        return out

    def _search(self, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam (positions and similarities, the best first) of every query on one level."""
        rows = max(16, min(1024, (1 << 26) // max(1, len(near))))
        if len(q) > rows:
            parts = [self._search(near, q[i : i + rows], entry[i : i + rows], beam, steps) for i in range(0, len(q), rows)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        every = np.arange(len(q))
        seen = np.zeros((len(q), len(near)), bool)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        e = min(beam, entry.shape[1])
        ids[:, :e] = entry[:, :e]
        sims[:, :e] = np.where(entry[:, :e] < 0, -np.inf, np.einsum("ikd,id->ik", self.x[entry[:, :e]], q))
        np.put_along_axis(seen, np.maximum(entry[:, :e], 0), True, 1)
        wide, act = np.zeros(ids.shape, bool), every
        while True:
            todo = np.where(wide[act] | (ids[act] < 0), -np.inf, sims[act])
            pick = np.argpartition(-todo, min(steps, beam) - 1, 1)[:, :steps]
            good = np.isfinite(np.take_along_axis(todo, pick, 1))
            live = good.any(1)
            act, pick, good = act[live], pick[live], good[live]
            if not len(act):
                break
            wide[act[:, None], pick] |= good
            nb = near[ids[act[:, None], pick]]
            nb[~good] = -1
            nb = np.sort(nb.reshape(len(act), -1), 1)
            drop = (nb < 0) | seen[act[:, None], nb]
            drop[:, 1:] |= nb[:, 1:] == nb[:, :-1]
            r, c = np.nonzero(~drop)
            seen[act[r], nb[r, c]] = True
            new = np.full(nb.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("id,id->i", self.x[nb[r, c]], q[act[r]])
            all_ids, all_sims = np.concatenate([ids[act], nb], 1), np.concatenate([sims[act], new], 1)
            all_wide = np.concatenate([wide[act], np.zeros(nb.shape, bool)], 1)
            top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            sims[act] = np.take_along_axis(all_sims, top, 1)
            ids[act] = np.where(np.isfinite(sims[act]), np.take_along_axis(all_ids, top, 1), -1)
            wide[act] = np.take_along_axis(all_wide, top, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _descend(self, q: np.ndarray, beam: int = 8) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int32)
        for near in self.levels:
            entry, _ = self._search(near, q, entry, beam)
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the vectors in each query's beam (-1: none) and their similarities."""
        entry = np.zeros((len(q), 1), np.int32)
        for near in self.levels[:-1]:
            entry, _ = self._search(near, q, entry, 8)
        ids, sims = self._search(self.levels[-1], q, entry, beam)
        return np.where(ids < 0, -1, self.order[ids]), sims


class Shard:
    """A shard's vectors, graph and beam. `recalls` has what all audits measured (links found of links there, a vector's with itself included), `settled` the last of each batch."""

    def __init__(self, vectors: np.ndarray, least: float, beam: int = 48, target: float = 0.98, audit: int = 32):
        self.exact = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.graph = Graph(self.exact)
        self.least, self.beam, self.target, self.audit = least, beam, target, audit
        self.recalls: list[tuple[int, int]] = []
        self.settled: list[tuple[int, int]] = []

    def _found(self, q: np.ndarray) -> list[np.ndarray]:
        single, out, todo, beam = q.astype(np.float32), [np.zeros(0, np.int64)] * len(q), np.arange(len(q)), min(self.beam, len(self.exact))
        while len(todo):
            ids, sims = self.graph.search(single[todo], beam)
            near = (ids >= 0) & (sims >= self.least - _NEAR)
            full = near[:, -1] & (beam < len(self.exact))
            for i in np.flatnonzero(near.any(1) & ~full).tolist():
                out[todo[i]] = ids[i, near[i]]
            todo, beam = todo[full], min(4 * beam, len(self.exact))
        return out

    def links(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each vector the shard's vectors with a cosine of at least `least`, itself included."""
        q = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        while True:
            found = self._found(q)
            found = [f[self.exact[f] @ v >= self.least] if len(f) else f for f, v in zip(found, q, strict=True)]
            some = np.argsort([-min(len(f), 2) for f in found], kind="stable")[: self.audit]
            some = np.union1d(some, np.linspace(0, len(q) - 1, self.audit).astype(int)) if len(q) else some
            there = (q[some] @ self.exact.T >= self.least).sum(1)
            got = sum(len(found[i]) for i in some)
            self.recalls.append((got, int(there.sum())))
            if got >= self.target * there.sum() or self.beam >= len(self.exact):
                self.settled.append(self.recalls[-1])
                return found
            self.beam *= 2


def near_links(nodes: DataFrame, least: float = 0.95, min_shards: int = 8, shard_bytes: int = 128 << 20, beam: int = 48) -> DataFrame:
    """nodes: (node, copies, embedding). Rows (a, b, n, there): n other vectors linked with a, in all its rows together; b, if any, in a's component. Rows without a are audits: n links found of those `there`.

    A shard has about `shard_bytes` of vectors in double precision at most, so a task's memory is bounded for any number of dimensions.
    """
    size = nodes.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    shards = max(min_shards, -(-8 * size // shard_bytes))
    rows = nodes.select(F.size("embedding").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "node", "copies", "embedding")
    rows = rows.withColumn("other", F.pmod("node", F.lit(shards)) != F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, shard, ids, copies, roots = [], None, None, None, None, None

        def values(t: pa.RecordBatch, dim: int) -> np.ndarray:
            return t.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

        def answer(node: np.ndarray, vectors: np.ndarray, inside: bool) -> pa.RecordBatch:
            nonlocal roots
            a, b, n = [], [], []
            for i in range(0, len(node), 2048):
                found = shard.links(vectors[i : i + 2048])
                if inside:
                    for k, f in enumerate(found, i):
                        for j in f.tolist():
                            x, y = top(k), top(j)
                            roots[max(x, y)] = min(x, y)
                for k, f in enumerate(found, i):
                    total = int(copies[f].sum()) - (int(copies[k]) if inside and k in f else 0)
                    a.append(node[k])
                    b.append(None)
                    n.append(total)
                    if not inside:
                        more = {top(j) for j in f.tolist()}
                        a += [node[k]] * len(more)
                        b += [ids[j] for j in more]
                        n += [0] * len(more)
            if inside:
                far = [(node[k], ids[top(k)]) for k in range(len(node)) if top(k) != k]
                a, b, n = a + [x for x, _ in far], b + [y for _, y in far], n + [0] * len(far)
            keep = [k for k in range(len(a)) if n[k] or b[k] is not None]
            got, there = (sum(r[j] for r in shard.settled) for j in (0, 1))
            shard.settled.clear()
            cols = [a[k] for k in keep] + [None], [b[k] for k in keep] + [None], [n[k] for k in keep] + [got], [None] * len(keep) + [there]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n", "there"])

        def top(i: int) -> int:
            while roots[i] != i:
                roots[i] = roots[roots[i]]
                i = roots[i]
            return i

        def built() -> pa.RecordBatch:
            nonlocal shard, ids, copies, roots, own
            vectors = np.concatenate([values(t, key[0]) for t in own])
            ids, copies = (np.concatenate([t.column(c).to_numpy() for t in own]) for c in ("node", "copies"))
            own, roots, shard = [], list(range(len(ids))), Shard(vectors, least, beam)
            return answer(ids, vectors, True)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "shard", "other")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                now, part = tuple(keys[i, :2].tolist()), batch.slice(i, j - i)
                if now != key:
                    if own:
                        yield built()
                    key, shard = now, None
                if not keys[i, 2]:
                    own.append(part)
                    continue
                if own:
                    yield built()
                if shard is not None:
                    yield answer(part.column("node").to_numpy(), values(part, key[0]), False)
        if own:
            yield built()

    # By range, so that every shard has a task of its own.
    dealt = rows.repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "other", "node")
    return dealt.mapInArrow(run, "a long, b long, n long, there long")


def near_duplicates(table: DataFrame, least: float = 0.95, **kw) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept, recall) for each row of (vec_id, embedding)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", usable.alias("usable"), F.when(usable, F.xxhash64("embedding")).alias("node"), "embedding")
    nodes = checkpointed(rows.where("usable").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")))
    links = checkpointed(near_links(nodes.select("node", "copies", "embedding"), least, **kw))
    audit = links.where("a IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("there"), F.lit(0))).first()
    recall = audit[0] / audit[1] if audit[1] else 1.0
    if recall < 0.9:
        raise RuntimeError(f"the graphs find {recall:.3f} of the links only")
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("a IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = checkpointed(nodes.select("node", "copies", "first").join(counts, "node", "left").join(roots, "node", "left").select("node", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first", F.coalesce("root", "node").alias("root")))
    names = checkpointed(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(known.select("node", "copies", "n_links", "root").join(names, "root").select("node", "copies", "n_links", "component_id"))
    linked = attached(checkpointed(rows.where("usable").select("vec_id", "node")), named, "node", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("recall"))
