"""Filling sequences of fixed capacity with texts, measured in tokens.

Hierarchical residual packing: every partition packs its own items best-fit and emits the bins that are nearly full.
Underfull bins become items themselves, carry their members along, and meet those of other partitions in fewer, larger
groups, round after round, until no round gains anything.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before byte pairs are merged (the pattern that belongs to this public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Items that one task packs at a time.
MOST_ITEMS = 500_000
#: A bin with at most this part of its capacity free is emitted at once.
NEARLY_FULL = 0.005
FAN_IN = 8

_encoders: dict = {}


def _encoder(vocabulary: bytes, pattern: str):
    key = hashlib.sha256(vocabulary).digest(), pattern
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each row's whole text; 0 for an empty or null text. Strings of special tokens are ordinary text.

    ``tokenizer`` is a vocabulary file that the driver can read; its content is sent to the workers.
    """
    held = documents.sparkSession.sparkContext.broadcast(_vocabulary(tokenizer))  # a vocabulary of some 100,000 tokens has about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(held.value, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc"), pa.array(n, pa.int64())], names=["doc", "n"])

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n long")
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, packed best-fit in falling order of size (ties in order of input). Sizes are 1 to ``capacity``.

    Open bins are kept by their free room; a bit for each room that occurs finds the least that suffices.
    """
    bins = np.empty(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}
    mask, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            own = rooms[room]
            b = own.pop()
            if not own:
                mask ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        room -= s
        if room:
            own = rooms.setdefault(room, [])
            if not own:
                mask |= 1 << room
            own.append(b)
    return bins


_MEMBER = "struct<doc:{kind},piece:int,n:long>"


def _round(items: DataFrame, capacity: int, schema: str, number: int) -> DataFrame:
    """Every partition's items (size, members) as bins; ``full`` marks those that are emitted. A bin is named by round, partition and place."""

    def pack(t: pa.Table, made: int) -> pa.RecordBatch:
        size = t.column("size").to_numpy()
        bins = best_fit(size, capacity)
        o = np.argsort(bins, kind="stable")
        at = np.flatnonzero(np.r_[True, bins[o][1:] != bins[o][:-1]])
        total = np.add.reduceat(size[o], at)
        members = t.column("members").take(pa.array(o)).combine_chunks()
        ends = np.r_[members.offsets.to_numpy()[at], members.offsets.to_numpy()[-1]]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members.values)
        names = [f"{number}-{TaskContext.get().partitionId()}-{made + i}" for i in range(len(total))]
        return pa.record_batch([pa.array(names), pa.array(total), lists, pa.array(capacity - total <= capacity * NEARLY_FULL)], names=["bin", "size", "members", "full"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, made = [], 0, 0
        for b in batches:
            if b.num_rows:
                kept.append(b)
                rows += b.num_rows
            if rows >= MOST_ITEMS:
                yield (out := pack(pa.Table.from_batches(kept).combine_chunks(), made))
                kept, rows, made = [], 0, made + out.num_rows
        if rows:
            yield pack(pa.Table.from_batches(kept).combine_chunks(), made)

    return items.select("size", "members").mapInArrow(run, schema)


def next_groups(left: int, groups: int | None) -> int:
    """In how many groups ``left`` underfull bins are packed next: ``FAN_IN`` times fewer than before, but none larger than ``MOST_ITEMS``."""
    least = max(1, -(-left // MOST_ITEMS))
    return least if groups is None else max(least, groups // FAN_IN)


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Items assigned to bins: ``item_id``, ``piece``, ``start`` (of the piece in its item), ``n`` and ``bin``.

    An item is divided only if it is larger than ``capacity``: into full pieces and the rest. Items of size 0 or null
    take no room and are left out; every other row is an item, rows with equal ids too. A round's underfull bins are written to the shared folder and counted; the last round is the one that
    ends in one task, or that no longer makes a tenth fewer bins.
    """
    kind = items.schema[item_id].dataType.simpleString()
    member = _MEMBER.format(kind=kind)
    n = F.col(size).cast("long")
    rows = items.where(n > 0).select(F.col(item_id).alias("doc"), n.alias("n"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(capacity)).cast("int") - 1)))
    part = F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * F.lit(capacity).cast("long"))
    open_ = pieces.select(part.alias("size"), F.array(F.struct("doc", "piece", part.alias("n"))).cast(f"array<{member}>").alias("members"))
    schema = f"bin string, size long, members array<{member}>, full boolean"
    done, groups, before, number = [], None, None, 0
    while True:
        made = written(_round(open_, capacity, schema, number), "bins")
        number += 1
        left = made.where("not full").count()
        done.append(made.where("full"))
        if groups == 1 or left == 0 or (before is not None and left > 0.9 * before):  # one group has at most MOST_ITEMS
            done.append(made.where("not full"))
            break
        groups = next_groups(left, groups)
        before = left
        # Mixed by a hash of the first member, so that each group sees bins of all partitions.
        open_ = made.where("not full").repartition(groups, F.xxhash64(F.col("members")[0]["doc"], F.col("members")[0]["piece"]))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    out = bins.select("bin", F.explode("members").alias("m"))
    return out.select(F.col("m.doc").alias(item_id), F.col("m.piece").alias("piece"), (F.col("m.piece") * F.lit(capacity).cast("long")).alias("start"), F.col("m.n").alias("n"), "bin")
