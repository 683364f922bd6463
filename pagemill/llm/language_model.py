"""Scores of texts under a hierarchical Pitman-Yor model of words, seated by Gibbs sampling.

The root restaurant seats words over a uniform base of V + 1 outcomes (the last stands for all unknown
words). Every word that stands before another one, and the start of a text, has a restaurant of its own,
a child of the root; a table in a child is a customer of the root. `contexts` restricts the children to
that many of the most frequent words, for comparison; a word after any other word is then seated in the
root itself. Discounts come from the counts of counts, n1 / (n1 + 2 n2).

The corpus is counted whole, as pairs of a word and the one before it: words are 64-bit hashes, summed
per task before they are shuffled. Words, restaurants and pairs are three tables; a sweep joins the pairs
with the root's word by one key and with the restaurant's total by the other, and reseats them in
parallel by the totals of the sweep before. Pairs seen once have one seating only and are left out of
the sweeps. A step takes all customers of a dish in a restaurant away and seats them one by one anew,
given the tables of all other dishes (as they were in the sweep before), exactly at any number of
customers (`seat`); all draws are hashes of word, restaurant and sweep. After `burn` sweeps the predictive probabilities of `samples` sweeps are averaged.

Scoring: the `dense` most frequent pairs are broadcast with their probabilities. Other pairs of a text
are summed per document and pair and joined with the model by a 64-bit hash of the pair.

Defined cases: a null text is an empty one, of an end alone; unknown words get the probability of the
last outcome; a word never seen before another one has an empty restaurant, which is the root; a null
doc_id is neither held out nor learned from; repeated rows are scored (and, where not held out, learned)
each; without training texts N and V are 0 and an outcome is certain; only doc_id and text are read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, text_or_empty

#: No word holds white space, so these are apart from all words' hashes.
_HASH = lambda b: xxhash.xxh64_intdigest(b, 42) - (1 << 63)
END, START = _HASH(b"\n"), _HASH(b" ")
_TOKENS = 500_000
_FLUSH = 1_500_000


def held_out(mod: int = 10, rest: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest, F.lit(False))


def learned_from(mod: int = 10, rest: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) != rest, F.lit(False))


def tokens(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole texts: their tokens' hashes, end tokens included, and each text's number of tokens."""
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        hashes += [digest(w, 42) for w in words]
        hashes.append(END + (1 << 63))
        counts.append(len(words) + 1)
        if len(hashes) >= _TOKENS:
            yield (np.array(hashes, np.uint64) ^ np.uint64(1 << 63)).view(np.int64), np.array(counts)
            hashes, counts = [], []
    if counts:
        yield (np.array(hashes, np.uint64) ^ np.uint64(1 << 63)).view(np.int64), np.array(counts)


def before(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each; START before the first of a text."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[np.cumsum(counts) - counts] = START
    return out


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def joint(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of the pair, as `_joint` in Spark."""
    x = u.view(np.uint64)
    return w ^ ((x << np.uint64(17)) | (x >> np.uint64(47))).view(np.int64)


def _joint() -> Column:
    return F.col("w").bitwiseXOR(F.shiftleft("u", 17).bitwiseOR(F.shiftrightunsigned("u", 47)))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts rows by the keys, the places in it where equal rows begin, and how many follow."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def counted(docs: DataFrame) -> DataFrame:
    """Rows (u, w, n, m): how often word w follows u in texts that are learned from, and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, w, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first, m = _runs(u, w)
            n = np.add.reduceat(own[order].astype(np.int64), first)
            return pa.RecordBatch.from_arrays([pa.array(u[order[first]]), pa.array(w[order[first]]), pa.array(n), pa.array(m)], ["u", "w", "n", "m"])

        for b in batches:
            own, at = b.column(1).to_numpy(zero_copy_only=False), 0
            for hashes, counts in tokens(t.as_py() for t in b.column(0)):
                held.append((before(hashes, counts), hashes, np.repeat(own[at : at + len(counts)], counts)))
                at += len(counts)
                size += len(hashes)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    rows = docs.select(F.col("text").cast("string").alias("text"), learned_from().alias("own")).mapInArrow(run, "u long, w long, n long, m long")
    return rows.groupBy("u", "w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) from hashes of the keys."""
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            x = (np.asarray(k).astype(np.int64).view(np.uint64) if isinstance(k, np.ndarray) else np.uint64(k)) + x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) * (1 / (1 << 53))


def _lgamma(z: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series after a shift."""
    small = z < 8
    shift, x = np.zeros_like(z), np.array(z, np.float64)
    for _ in range(8):
        shift = np.where(small, shift + np.log(x), shift)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def _seated(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, *keys) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes after all their customers are seated one by one, and the logarithms of the products of what each choice was divided by.

    With i customers at t tables, the next one opens a table by a / (i - d t + a), a = new + grow t. The place of the
    next opening is drawn at once, from the product of the chances of none before (a ratio of gamma functions), so a
    dish costs its tables rather than its customers, at any number of them.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    at, weight, step = tables.copy(), np.zeros(len(customers)), 0
    act = np.flatnonzero(customers > at)
    while len(act):
        step += 1
        t, i, n = tables[act], at[act], customers[act].astype(np.float64)
        low = -discount * t
        c = low + new[act] + grow[act] * t
        none = lambda j: _lgamma(j + low) - _lgamma(j + c)  # noqa: E731, B023
        start = none(i)
        with np.errstate(divide="ignore"):
            least = np.log(uniform(step, *(k[act] if isinstance(k, np.ndarray) else k for k in keys)))
        opens = none(n) - start < least
        # Where a table is opened: the last number of customers without one is in [lo, hi).
        lo, hi = i.copy(), np.where(opens, n, i + 1)
        while (wide := hi - lo > 1).any():
            mid = np.where(wide, np.floor((lo + hi) / 2), lo)
            still = none(mid) - start >= least
            lo, hi = np.where(wide & still, mid, lo), np.where(wide & ~still, mid, hi)
        end = np.where(opens, lo + 1, n)
        weight[act] += _lgamma(end + c) - _lgamma(i + c)
        tables[act] += opens
        at[act] = end
        act = act[end < n]
    return tables, weight


@cache
def _arrangements(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: in row n and column t the weight of all seatings of n customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], np.where(n > discount * t, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf) + out[n, 1 : n + 2])
    return out


def _counted_tables(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, *keys, high: int) -> np.ndarray:
    """Numbers of tables drawn from their probabilities given everything else, by weighing each number there can be.

    high: no dish has more customers. A worker keeps a table of weights for each `high` that it is given, so these must be few.
    """
    most = int(customers.max())
    with np.errstate(divide="ignore"):
        opens = np.log(new[:, None] + grow[:, None] * np.arange(1, most)[None])
    weight = _arrangements(discount, high)[:, 1 : most + 1][customers]
    weight[:, 1:] += np.cumsum(opens, 1)
    chance = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
    return 1 + (chance < np.broadcast_to(uniform(1 << 39, *keys), len(customers))[:, None] * chance[:, -1:]).sum(1)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, *keys, grow: np.ndarray | float = 0.0, tries: int = 3) -> np.ndarray:
    """A Gibbs step for each dish: all its customers leave and are seated anew, given everything else.

    new: the weight of a first table of the dish (concentration and others' tables, times the parent's probability); grow:
    by how much it rises with each table. Up to 1024 customers the number of tables is drawn at once, from the weights of all
    arrangements with so many. Beyond, customers are seated one after another by chances that are each divided by
    their sum; the products of these sums decide, by Metropolis and Hastings, whether the next of `tries` seatings takes the
    place of the one before, so that here too the arrangement's own probability is what is drawn from.
    """
    grow, out = np.broadcast_to(np.asarray(grow, np.float64), customers.shape), np.zeros(len(customers), np.int64)
    new, only = np.broadcast_to(np.asarray(new, np.float64), customers.shape), lambda at: [k[at] if isinstance(k, np.ndarray) else k for k in keys]
    for low, high in ((0, 8), (8, 32), (32, 256), (256, _AT_ONCE)):
        every = np.flatnonzero((customers > low) & (customers <= high))
        for at in np.array_split(every, -(-len(every) * high // (1 << 18)) or 1):
            if len(at):
                out[at] = _counted_tables(customers[at], new[at], grow[at], discount, *only(at), high=high)
    for at in np.flatnonzero(customers > _AT_ONCE)[:, None]:
        out[at] = _seated_apart(customers[at], new[at], grow[at], discount, tries, *only(at))
    return out


_AT_ONCE, _ONE_BY_ONE = 1024, 1 << 22


def _one_by_one(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, *keys) -> tuple[np.ndarray, np.ndarray]:
    """What `_seated` draws, for one dish, customer by customer: it costs its customers rather than its tables."""
    n, opens, more, t, at = int(customers[0]), float(new[0]), float(grow[0]), 1, []
    for i, u in enumerate(uniform(np.arange(1, n), *keys).tolist(), 1):
        at.append(t)
        a = opens + more * t
        if u * (i - discount * t + a) < a:
            t += 1
    seats = np.array(at, np.float64)
    return np.array([t], np.float64), np.array([np.log(np.arange(1, n) - discount * seats + opens + more * seats).sum()])


def _seated_apart(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, tries: int, *keys) -> np.ndarray:
    draw = _one_by_one if len(customers) == 1 and 1 < customers[0] <= _ONE_BY_ONE else _seated
    tables, weight = draw(customers, new, grow, discount, 1 << 40, *keys)
    for k in range(1, tries):
        other, its = draw(customers, new, grow, discount, (1 << 40) + k, *keys)
        with np.errstate(divide="ignore"):
            better = np.log(uniform((1 << 41) + k, *keys)) < its - weight
        tables, weight = np.where(better, other, tables), np.where(better, its, weight)
    return tables.astype(np.int64)


def _reseat(sweep: int, discount: float, keep: bool):
    """Seats pairs anew by p0, the root's probability of the word, and the weight of the restaurant's new tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, w, n, t, ts, p0, weight = (b.column(x).to_numpy() for x in ("u", "w", "n", "t", "ts", "p0", "weight"))
            t = seat(n, (weight - discount * t) * p0, discount, w, u, sweep, grow=discount * p0)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("w"), b.column("n"), b.column("m"), pa.array(t), pa.array(ts + t if keep else ts)], ["u", "w", "n", "m", "t", "ts"])

    return run


def _reseat_root(sweep: int, discount: float, new: float, base: float):
    """As _reseat, in the root: new is its concentration and tables, base its parent's probability of any word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, c0 = b.column("w").to_numpy(), b.column("c0").to_numpy()
            before = b.column("t0").to_numpy()
            t0 = seat(c0, (new - discount * before) * base, discount, w, 1 << 20, sweep, grow=discount * base)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t0)], b.schema.names)

    return run


class Model:
    def __init__(self, docs: DataFrame, contexts: int | None = None, burn: int = 2, samples: int = 2, dense: int = 1 << 20, theta: float = 1.0):
        self.dense, self.samples, self.theta, self.listed = dense, samples, theta, None
        pairs = counted(docs)
        if contexts is not None:
            pairs = stored(pairs)
            frequent = pairs.where(F.col("w") != END).groupBy("w").agg(F.sum("n").alias("c")).where("c > 0").orderBy(F.desc("c"), "w").limit(contexts).collect()
            self.listed = np.sort(np.array([START, *(r.w for r in frequent)], np.int64))
            pairs = pairs.withColumn("u", F.when(F.col("u").isin(self.listed.tolist()), F.col("u")).otherwise(END)).groupBy("u", "w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        # No word follows an END, so it marks pairs without a restaurant.
        self.pairs = stored(pairs)
        train, n, inner = self.pairs.where("n > 0"), F.col("n"), F.col("u") != END
        sums = train.groupBy("w").agg(F.sum("n").alias("c"), F.sum(F.when(~inner, n).when(n == 1, 1).otherwise(0)).alias("fixed"), F.count_if(inner & (n > 1)).alias("more"))
        self.words = stored(sums.select("*", (F.col("fixed") + F.col("more")).alias("c0"), F.lit(1).cast("long").alias("t0")))
        rooms = train.where(inner).groupBy("u").agg(F.sum("n").alias("customers"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice"), F.count(F.lit(1)).alias("t"))
        self.rooms = stored(rooms.withColumn("more", F.col("t") - F.col("once")))
        discount = lambda n1, n2: min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
        said = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        room = self.rooms.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
        self.n, self.v = int(said[0]), int(said[1])
        self.d0, self.d1 = discount(said[2], said[3]), discount(room[0], room[1])
        self._sweep(burn, train.where(inner & (n > 1)).select("*", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("ts")))

    def _root(self) -> tuple[int, int]:
        got = self.words.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("t0"), F.lit(0))).first()
        return int(got[0]), int(got[1])

    def _sweep(self, burn: int, pairs: DataFrame) -> None:
        """All sweeps. `seated`: pairs seen more than once, with their tables summed over the samples; words get their root's probability and rooms their weight of the root in each sample."""
        theta, d0, d1, base = self.theta, self.d0, self.d1, 1 / (self.v + 1)
        self.roots, self.seated = [], pairs
        root_c, root_t = self._root()
        root = lambda c, t: (F.col("c0") - d0 * F.col("t0") + (theta + d0 * t) * base) / (theta + c)
        for sweep in range(burn + self.samples):
            old = self.seated, self.words, self.rooms
            sample = sweep - burn
            p0 = self.words.where("more > 0").select("w", root(root_c, root_t).alias("p0"))
            weight = self.rooms.where("more > 0").select("u", (theta + d1 * F.col("t")).alias("weight"))
            self.seated = stored(self.seated.join(p0, "w").join(weight, "u").mapInArrow(_reseat(sweep, d1, sample >= 0), "u long, w long, n long, m long, t long, ts long"))
            new = self.words.drop("c0").join(self.seated.groupBy("w").agg(F.sum("t").alias("s")), "w", "left").withColumn("c0", F.col("fixed") + F.coalesce("s", F.lit(0))).drop("s")
            # Tables of the root are customers of nobody: they need the root's totals only.
            new = new.select(*(c for c in new.columns if c != "t0"), "t0")
            words = stored(new.mapInArrow(_reseat_root(sweep, d0, theta + d0 * root_t, base), new.schema))
            self.words = words
            rooms = self.rooms.drop("t").join(self.seated.groupBy("u").agg(F.sum("t").alias("s")), "u", "left").withColumn("t", F.col("once") + F.coalesce("s", F.lit(0))).drop("s")
            root_c, root_t = self._root()
            if sample >= 0:
                self.roots.append((root_c, root_t))
                rooms = rooms.withColumn(f"back_{sample}", (theta + d1 * F.col("t")) / (theta + F.col("customers")))
                self.words = stored(words.withColumn(f"root_{sample}", root(root_c, root_t)))
                dropped(words)
            self.rooms = stored(rooms)
            for x in old:
                if hasattr(x, "stored_at"):
                    dropped(x)

    @property
    def contexts(self) -> np.ndarray:
        """The restaurants' words; for looking at small models."""
        return np.sort(np.array([r.u for r in self.rooms.select("u").collect()], np.int64))

    def _unknown(self) -> np.ndarray:
        """What the root gives an unknown word, in each sample."""
        return np.array([(self.theta + self.d0 * t) / (self.theta + c) / (self.v + 1) for c, t in self.roots])

    def _constants(self) -> tuple[np.ndarray, np.ndarray]:
        """For each sample: what the root gives an unknown word, and each context's weight of the root; for looking at small models."""
        rows = self.rooms.orderBy("u").collect()
        return self._unknown(), np.array([[r[f"back_{s}"] for r in rows] for s in range(self.samples)])

    def probable(self, where: Column) -> DataFrame:
        """Rows (u, w, n, c, p): the averaged probability of w after u, for the pairs that `where` (a condition on m) picks; c is 0 for unknown words."""
        n, none, samples = F.col("n"), F.col("u") == END, range(self.samples)
        single = self.pairs.where((n < 2) | none).select("u", "w", "n", "m", (n * self.samples).alias("ts"))
        pairs = single.unionByName(self.seated.select("u", "w", "n", "m", "ts")).where(where)
        words = self.words.select("w", "c", *(f"root_{s}" for s in samples))
        rooms = self.rooms.select("u", "customers", *(f"back_{s}" for s in samples))
        seen = F.when(none | (n == 0), 0.0).otherwise((n - self.d1 / self.samples * F.col("ts")) / (self.theta + F.col("customers")))
        rest = sum((F.coalesce(f"back_{s}", F.lit(1.0)) * F.coalesce(f"root_{s}", F.lit(float(x))) for s, x in enumerate(self._unknown())), F.lit(0.0))
        return pairs.join(words, "w", "left").join(rooms, "u", "left").select("u", "w", "n", F.coalesce("c", F.lit(0)).alias("c"), (seen + rest / self.samples).alias("p"))

    def predictive(self) -> DataFrame:
        """Rows (w, c, root, seen): the word's probability in the root for each sample, and the averaged ones of contexts it was seen in, by their place in `contexts`; for looking at small models."""
        at = F.array_position(F.array(*(F.lit(int(u)) for u in self.contexts)), F.col("u")) - 1
        seen = self.probable(F.lit(True)).where((F.col("n") > 0) & (F.col("u") != END)).groupBy("w").agg(F.collect_list(F.struct(at.cast("int").alias("k"), "p")).alias("seen"))
        return self.words.join(seen, "w", "left").select("w", "c", F.array(*(f"root_{s}" for s in range(self.samples))).alias("root"), F.coalesce("seen", F.array().cast("array<struct<k:int,p:double>>")).alias("seen"))

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
        # The most frequent pairs, as many whole steps of an eighth of an octave as `dense` holds.
        step = F.floor(F.log2("m") * 8)
        least, room = 1 << 62, self.dense
        for r in self.pairs.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            if (room := room - r["count"]) < 0:
                break
            least = r.step
        top = self.probable(step >= least).select(_joint().alias("h"), "c", F.log10("p").cast("float").alias("high")).toArrow()
        keys, c, high = (top.column(n).to_numpy() for n in ("h", "c", "high"))
        order = np.argsort(keys)
        den = self.n + 0.1 * (self.v + 1)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], high[order], np.log10((c[order] + 0.1) / den), c[order] > 0))
        listed = self.listed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, table, base, knows = shared.value
            for b in batches:
                doc, at = b.column("key").to_numpy(), 0
                for hashes, counts in tokens(t.as_py() for t in b.column("text")):
                    own = doc[at : at + len(counts)]
                    of = np.repeat(np.arange(len(counts)), counts)
                    u = before(hashes, counts)
                    if listed is not None:
                        u = np.where(place(listed, u) >= 0, u, END)
                    h = joint(u, hashes)
                    i = place(keys, h)
                    hit = i >= 0
                    total = lambda x: np.bincount(of[hit], weights=x[i[hit]], minlength=len(counts)) if len(x) else np.zeros(len(counts))  # noqa: E731, B023
                    known, low, high = total(knows), total(base), total(table)
                    # Pairs outside the table, summed per document.
                    f, g = of[~hit], h[~hit]
                    s, first, n = _runs(f, g)
                    f, g = f[s[first]], g[s[first]]
                    m, r = len(counts), len(first)
                    pad = lambda x: pa.array(np.concatenate([x, np.zeros(r, x.dtype)]))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([own, own[f]])), pa.array(np.concatenate([own, g])), pa.array(np.repeat([False, True], [m, r])), pa.array(np.concatenate([counts, n]).astype(np.int32)), pad(known.astype(np.int64)), pad(low), pad(high)],
                        ["key", "h", "rare", "n", "known", "base", "high"],
                    )
                    at += len(counts)

        text = text_or_empty("text")
        key = F.xxhash64("doc_id", text)
        rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, h long, rare boolean, n int, known long, base double, high double")
        rest = self.probable(step < least).select(_joint().alias("h"), F.lit(True).alias("rare"), "c", "p")
        rare, c = F.col("rare"), F.col("c")
        sums = rows.join(rest, ["h", "rare"], "left").groupBy("key").agg(
            F.count_if(~rare).alias("copies"), F.sum(F.when(~rare, F.col("n")).otherwise(0)).alias("n_tokens"), F.sum(F.when(rare, F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
            F.sum(F.when(rare, F.col("n") * F.log10((c + 0.1) / den)).otherwise(F.col("base"))).alias("base_score"), F.sum(F.when(rare, F.col("n") * F.log10("p")).otherwise(F.col("high"))).alias("score"),
        )
        ids = docs.select("doc_id", held_out().alias("held_out"), key.alias("key"))
        mean_of = lambda name, kind: (F.col(name) / F.col("copies")).cast(kind).alias(name)
        return ids.join(sums, "key").select("doc_id", "held_out", mean_of("n_tokens", "long"), mean_of("n_known", "long"), F.lit(self.n).cast("long").alias("train_tokens"), mean_of("base_score", "double"), mean_of("score", "double"))


def score(docs: DataFrame, **kw) -> DataFrame:
    return Model(docs, **kw).score(docs)
