"""Best-fit packing of token pieces into sequences: hierarchical residual packing.

Documents become ids of a public byte-level BPE vocabulary and an end id. One longer than a sequence
is cut into whole sequences, its first piece taking the rest. Each partition packs its pieces by
best fit, largest first. Bins that are nearly full are emitted; underfull bins become the items of
the next round, in which a tree of fewer partitions packs them again. A bin carries its pieces, so
no join is needed to place them, and a round moves underfull bins only.

A task of a later round is dealt about `task_items` bins. Rounds end when one task's worth is left
and has been packed, or when a round with the least number of tasks saves less than one bin in a
hundred, so what can't be merged (bins all over half full) never meets in one task.

Ids: `tokenizers` defines them (special strings are ordinary text, nothing is added). Texts are
encoded word by word with a bounded memory of words. A cut before a space or around a single newline
between other characters is one that the pre-tokenizer makes too, so the ids are those of the whole
text; other white space goes by the pattern. New words are encoded from the same vocabulary's rank
file by the faster of two public encoders, which each worker first holds against `tokenizers`.

Defined cases: a null text is an empty one and gives the end id alone; repeated rows are packed each;
ties go by doc_id, piece and checksum; only the id and text columns are read; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
#: White space as the pre-tokenizer's pattern takes it.
_SPACE = "\t-\r \x85\xa0  -     　"
_PLAIN = re.compile(rf"^[{_SPACE}]|[{_SPACE}]{{2}}|[\t\x0b-\r\x85\xa0  -     　]|[{_SPACE}]$")
_CHUNKS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_PROBE = "It's a  probe,\n\n of 3 kinds:\té ñ 漢字 <|endoftext|> \x85 x y 'll \n z "


class Words(dict):
    """Little-endian ids of words, with `before` in front of each; remembers `most` of them."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, most: int):
        self.encode, self.before, self.most = encode, before, most

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.encode(self.before + word), "<u4").tobytes()
        if len(self) < self.most:
            self[word] = got
        return got


class Encoder:
    """Whole texts to little-endian ids."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        defines = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        defines.encode_special_tokens = True
        self.encode = fast.encode_ordinary
        self.spaced, self.bare = Words(self.encode, " ", most), Words(self.encode, "", most)
        self.newline = self.bare["\n"]
        if np.frombuffer(self(_PROBE), "<u4").tolist() != defines.encode(_PROBE, add_special_tokens=False).ids:
            raise RuntimeError("the two encoders of the vocabulary disagree")

    def __call__(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return b"".join(map(self.bare.__getitem__, _CHUNKS.findall(text)))
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *more = line.split(" ")
            if k:
                out.append(self.newline)
            if first:
                out.append(self.bare[first])
            out += map(self.spaced.__getitem__, more)
        return b"".join(out)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and with_ids the ids themselves (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            rows, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = encoder(text.as_py() or "") + end
                n = len(got) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, z - a, zlib.crc32(got[4 * a : 4 * z])))
                    if with_ids:
                        ids.append(np.frombuffer(got[4 * a : 4 * z], "<i4"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Items come largest first; each goes to a bin with the least room that holds it, the latest of such."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_rooms = 0  # bit r: some bin has room r
    for item, size in enumerate(sizes):
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
            bins[k].append(item)
        else:
            r, k = capacity, len(bins)
            bins.append([item])
        if left := r - size:
            room[left].append(k)
            open_rooms |= 1 << left
    return bins


_MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def _round(bins: DataFrame, tasks: int, number: int, capacity: int) -> DataFrame:
    """Packs each partition's bins as items. Rows (id, fill, members); ids are unique over all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got) if (got := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        members = t.column("members").chunk(0)
        groups = best_fit(t.column("fill").to_pylist(), capacity)
        order = pa.array([i for g in groups for i in g], pa.int64())
        fills, sizes = t.column("fill").to_numpy(), np.diff(members.offsets.to_numpy())
        taken = members.take(order)
        flat, ends = taken.flatten(), np.concatenate([[0], np.cumsum([sizes[g].sum() for g in groups])]).astype(np.int32)
        first = (number << 56) | (TaskContext.get().partitionId() << 32)
        for at in range(0, len(groups), 4096):
            own = groups[at : at + 4096]
            cut = ends[at : at + len(own) + 1]
            lists = pa.ListArray.from_arrays(pa.array(cut - cut[0]), flat.slice(cut[0], cut[-1] - cut[0]))
            yield pa.RecordBatch.from_arrays([pa.array([first + at + k for k in range(len(own))], pa.int64()), pa.array([int(fills[g].sum()) for g in own], pa.int32()), lists], ["id", "fill", "members"])

    key = F.xxhash64(F.col("members")[0])
    dealt = bins.repartition(tasks, key).sortWithinPartitions(F.desc("fill"), "members")
    return dealt.mapInArrow(run, f"id long, fill int, members {_MEMBER}")


def pack(cut: DataFrame, capacity: int = CAPACITY, nearly_full: float = 0.985, task_items: int = 50_000, fan_in: int = 8) -> DataFrame:
    """cut (rows of `pieces`) with sequence_id and offset: where each piece lies."""
    cut = checkpointed(cut.select("doc_id", "piece", "start", "length", "ids_crc32"))
    item = F.struct(*cut.columns)
    whole = cut.where(F.col("length") == capacity).select((F.monotonically_increasing_id() - F.lit(1 << 62)).alias("id"), F.array(item).alias("members"))
    left = cut.where(F.col("length") < capacity).select(F.col("length").cast("int").alias("fill"), F.array(item).alias("members"))
    done, number, count = [whole], 1, left.count()
    tasks = max(1, -(-count // task_items))
    while count:
        packed = checkpointed(_round(left, tasks, number, capacity))
        done.append(packed.where(F.col("fill") >= nearly_full * capacity).select("id", "members"))
        left = packed.where(F.col("fill") < nearly_full * capacity)
        before, count = count, left.count()
        least = max(1, -(-count // task_items))
        if tasks == least and (tasks == 1 or count > 0.99 * before):
            break
        left, tasks, number = left.select("fill", "members"), max(least, tasks // fan_in), number + 1
    if count:
        done.append(left.select("id", "members"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    placed = F.aggregate(
        F.col("members"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("offsets")),
        lambda s, m: F.struct((s["at"] + m["length"]).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets")),
        lambda s: s["offsets"],
    )
    return out.select("id", F.inline(F.arrays_zip(F.col("members").alias("m"), placed.alias("offset")))).select("m.*", F.col("id").alias("sequence_id"), "offset")
