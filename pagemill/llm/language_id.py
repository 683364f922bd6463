"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments. Two gated recurrent units, one in each direction, read a
segment; their states together give every position a probability for each language, and a document's
probabilities are the mean over all its positions. The network is trained here in numpy by
backpropagation through time, on a sample of labelled documents: at most about `per_language`
documents of each language, chosen by a hash, as whole texts. A step draws documents of all languages
alike, and a segment from anywhere in each. The sample is all that the driver sees of the texts.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is everything if
nothing can be learned; a null doc_id is neither held out nor learned from; repeated rows stay; ties
between languages go to the first by code point; only doc_id, text and lang are read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 64
NONE = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Weights: `table` (2, 256, 3h) from bytes to the gates of each direction, `own` (2, h, 3h) from the state,
    `bias` (2, h) inside the reset, `out` (2h, languages) and `base`."""

    NAMES = ("table", "own", "bias", "out", "base")

    def __init__(self, hidden: int, languages: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.h = hidden
        self.table, self.own, self.out = small(2, 256, 3 * hidden), small(2, hidden, 3 * hidden), small(2 * hidden, languages)
        self.bias, self.base = np.zeros((2, hidden), np.float32), np.zeros(languages, np.float32)

    def states(self, x: np.ndarray, keep: bool = False):
        """x: bytes (time, rows). States (2, time, rows, h), each direction in its own order of time; with keep, what backpropagation needs."""
        h, rows = self.h, x.shape[1]
        both = np.stack([x, x[::-1]], 1)
        out = np.empty((len(x), 2, rows, h), self.table.dtype)
        state, kept = np.zeros((2, rows, h), self.table.dtype), []
        for t in range(len(x)):
            gates = np.stack([self.table[0][both[t, 0]], self.table[1][both[t, 1]]])
            own = state @ self.own
            zr = _sigmoid(gates[..., : 2 * h] + own[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            inner = own[..., 2 * h :] + self.bias[:, None]
            new = np.tanh(gates[..., 2 * h :] + r * inner)
            if keep:
                kept.append((state, z, r, inner, new))
            state = new + z * (state - new)
            out[t] = state
        return (out, kept, both) if keep else out

    def label(self, out: np.ndarray) -> np.ndarray:
        """Probabilities (time, rows, languages) from states."""
        h = self.h
        logits = out[:, 0] @ self.out[:h] + out[::-1, 1] @ self.out[h:] + self.base
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the real positions (time, rows) of rows labelled y, and its gradients."""
        h = self.h
        out, kept, both = self.states(x, keep=True)
        p = self.label(out)
        n = real.sum()
        picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), 2)[..., 0]
        loss = float(-(np.log(np.maximum(picked, 1e-30)) * real).sum() / n)
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), (picked - 1)[..., None], 2)
        d *= (real / n)[..., None].astype(p.dtype)
        joint = np.concatenate([out[:, 0], out[::-1, 1]], -1)
        g = {"out": np.einsum("trh,trk->hk", joint, d, optimize=True), "base": d.sum((0, 1)), "own": np.zeros_like(self.own), "bias": np.zeros_like(self.bias), "table": np.zeros_like(self.table)}
        down = d @ self.out.T
        down = np.stack([down[..., :h], down[::-1, :, h:]], 1)
        dh, flows = np.zeros_like(out[0]), np.empty((len(x), 2, x.shape[1], 3 * h), self.table.dtype)
        for t in reversed(range(len(x))):
            before, z, r, inner, new = kept[t]
            dh = dh + down[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            into = np.concatenate([dz, dr, dn * r], -1)
            g["own"] += before.transpose(0, 2, 1) @ into
            g["bias"] += into[..., 2 * h :].sum(1)
            dh = dh * z + into @ self.own.transpose(0, 2, 1)
            flows[t, ..., : 2 * h], flows[t, ..., 2 * h :] = into[..., : 2 * h], dn
        for way in range(2):
            np.add.at(g["table"][way], both[:, way].ravel(), flows[:, way].reshape(-1, 3 * h))
        return loss, g


def train(x: np.ndarray, length: np.ndarray, of: np.ndarray, y: np.ndarray, languages: int, hidden: int = 8, steps: int = 400, rows: int = 128, rate: float = 0.02, seed: int = 0) -> Network:
    """Adam over batches with each language, and each document of it, equally often. x: segments (rows, time) of all documents in order, padded; length: their real bytes; of: their documents; y: the documents' languages."""
    net, rng = Network(hidden, languages, seed), np.random.default_rng(seed + 1)
    own, first = [np.flatnonzero(y == k) for k in range(languages)], np.searchsorted(of, np.arange(len(y) + 1))
    mean = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    square = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    for step in range(1, steps + 1):
        docs = np.array([rng.choice(own[k % languages]) for k in range(rows)])
        pick = rng.integers(first[docs], first[docs + 1])
        batch = x[pick].T
        _, g = net.gradients(batch, np.arange(len(batch))[:, None] < length[pick][None], y[docs])
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k in net.NAMES:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] ** 2 - square[k])
            setattr(net, k, (getattr(net, k) - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (rows, size) of all texts, their real lengths, and the text each is of."""
    n = np.array([len(t) for t in texts], np.int64)
    count = -(-n // size)
    of = np.repeat(np.arange(len(texts)), count)
    part = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size, n[of] - part * size)
    data = np.zeros((len(of), size), np.uint8)
    data[np.arange(size)[None] < length[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return data, length, of


def document_probabilities(net: Network, texts: list[bytes], rows: int = 2048) -> np.ndarray:
    data, length, of = segments(texts)
    out = np.zeros((len(texts), len(net.base)))
    for a in range(0, len(data), rows):
        p = net.label(net.states(np.ascontiguousarray(data[a : a + rows].T)))
        p *= (np.arange(data.shape[1])[:, None] < length[a : a + rows][None])[..., None]
        np.add.at(out, of[a : a + rows], p.sum(0))
    return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def held_out(mod: int, rest: int, id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == rest, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1000, max_languages: int = 200, min_bytes: int = 12, seed: int = 11, **kw) -> tuple[list[str], Network | None]:
    """The languages (sorted) and the network, learned from documents that aren't held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(4, 2) & (F.octet_length("text") >= min_bytes)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("bytes"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not counts:
        return [], None
    rate = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))))
    share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    got = usable.where(share < rate[F.col("lang")]).select("h", "lang", "bytes").limit(2 * per_language * len(counts)).collect()
    rows = sorted((r.h, r.lang, bytes(r.bytes)) for r in got)
    languages = sorted({lang for _, lang, _ in rows})
    if not rows:
        return [], None
    data, length, of = segments([p for _, _, p in rows])
    return languages, train(data, length, of, np.array([languages.index(lang) for _, lang, _ in rows]), len(languages), **kw)


def predict(docs: DataFrame, languages: list[str], net: Network | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            said = [net is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            name, score = np.full(len(texts), NONE, object), np.zeros(len(texts))
            at = np.flatnonzero(said)
            if len(at):
                p = document_probabilities(net, [texts[i].encode("utf-8", "surrogatepass") for i in at])
                best = p.argmax(1)
                name[at], score[at] = np.array(languages, object)[best], np.clip(p[np.arange(len(at)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(name.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **kw) -> DataFrame:
    return predict(docs, *fit(docs, **kw))


def keep_known(docs: DataFrame, least: float = 0.15, **kw) -> DataFrame:
    """docs without those that have no language, or whose best probability is less than `least` of the way from even chances to certainty. Columns and repeated rows stay as they are; an empty table, or one without labels to learn from, gives an empty result."""
    languages, net = fit(docs, **kw)
    even = 1 / max(1, len(languages))
    bar = even + least * (1 - even)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = pd.Series(False, index=text.index)
        there = text.map(lambda t: net is not None and t is not None and any(map(str.isalpha, t)))
        if there.any():
            out[there] = document_probabilities(net, [t.encode("utf-8", "surrogatepass") for t in text[there]]).max(1) >= bar
        return out

    return docs.where(known("text"))
