"""Best-fit packing of tokenized documents into sequences, under several capacities.

A bin has a vector of capacities: tokens, documents, and attention cost (the sum of squared
lengths). Items are placed longest first; a bin must have room in every capacity, and of
those that do, the one with the best score is taken: the least weighted norm of what would be left, or
the greatest weighted dot product of item and room.

Items of one length are alike, so the packing is planned on the histogram of lengths (at most ``capacity``
rows on the driver, whatever the corpus). Bins in the same state form a group; a step puts items
of one length into all bins of the best group, and splits the group where the items end. The plan is a
list of ranges: the items of a length from one rank to another go to consecutive bins at one offset.
Every document finds its place by its rank among the items of its length: its rank in its partition, plus the
counts of the partitions before, which are joined by partition and length. No task sees a whole length.

Defined results: a null text counts as empty, and is the end token alone. Equal lengths may go to any of their
places; reruns over the same rows and partitions agree. Repeated rows, and rows without a key, are packed each on its own; very
long texts are tokenized whole and cut into pieces; an empty table has an empty result. Columns but key and text play no part.
Every piece comes with what its whole sequence leaves of each capacity.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import slices, write_shared

#: The token that ends a document, and a fixed text that the vocabulary treats as one special token.
END, SPECIAL = 2, "<|endoftext|>"
#: Bytes of text that are tokenized at a time.
CHUNK = 1 << 19


class Tokenizer:
    """Byte-level BPE from a vocabulary file, with the same ids by either library.

    The rank file of the same vocabulary, where given, is several times faster and takes less memory; the tokenizer file then
    only gives the special token's id, at which a text is parted. Tests hold both equal on random texts.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.fast = path, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def full(self):
        from tokenizers import Tokenizer as Full

        return Full.from_file(self.path)

    @cached_property
    def special(self) -> int:
        with open(self.path) as f:
            return next(t["id"] for t in json.load(f)["added_tokens"] if t["content"] == SPECIAL)

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self.full.encode(text, add_special_tokens=False).ids
        first, *rest = text.split(SPECIAL)
        ids = self.fast.encode_ordinary(first)
        for part in rest:
            ids += [self.special, *self.fast.encode_ordinary(part)]
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str | None, pattern: str | None) -> Tokenizer:
    """One for each worker process, not for each task."""
    return Tokenizer(path, ranks, pattern)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, capacity) for at in range(first, n, capacity)]


def tokenize(df: DataFrame, key: str, text: str, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 [, ids], and part and place: the piece's rank among those of its length in its partition."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, ranks, pattern).encode
        part, seen = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for b in slices(whole, 1, CHUNK):
                rows = []
                for k, t in enumerate(b.column(1).to_pylist()):
                    ids = np.array([*encode(t), END], "<u4")
                    for i, (at, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[at : at + n].tobytes()
                        rows.append((k, i, at, n, zlib.crc32(own), part, seen[n], own if keep_ids else None))
                        seen[n] += 1
                own, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=["key", "piece", "start", "length", "ids_crc32", "part", "place", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    out = rows.mapInArrow(pieces, f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("key", key)


@dataclass
class Plan:
    """Ranges by length: from ``rank`` on, items go to bins from ``base`` on, ``each`` to a bin, the first of a bin at ``offset``."""

    bins: int = 0
    #: First bin, number of bins, and what they leave of tokens, documents and attention, for all groups of bins.
    left: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    ranges: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    def arrays(self) -> dict[int, np.ndarray]:
        return {n: np.array(r, np.int64).reshape(-1, 4) for n, r in self.ranges.items()}


def plan(histogram: dict[int, int], capacity: int, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> Plan:
    """Pack so many items of each length. documents, attention: the other capacities (default: never short)."""
    caps = np.array([capacity, documents or capacity, attention or capacity**2], float)
    w = np.array(weights)
    out = Plan()
    room = np.zeros((256, 3))  # of a bin of each group
    where = np.zeros((256, 3), np.int64)  # first bin, number of bins, tokens used
    n_groups = 0

    def add(left: np.ndarray, base: int, bins: int, used: int) -> None:
        nonlocal n_groups, room, where
        if left.min() < 1:
            out.left.append((base, bins, *map(int, left)))
            return
        if n_groups == len(room):
            room, where = np.vstack([room, np.zeros_like(room)]), np.vstack([where, np.zeros_like(where)])
        room[n_groups], where[n_groups] = left, (base, bins, used)
        n_groups += 1

    for n in sorted(histogram, reverse=True):
        todo, rank = histogram[n], 0
        item = np.array([n, 1, n * n], float)
        if (item > caps).any():
            raise ValueError(f"an item of {n} tokens fits into no bin")
        rows = out.ranges.setdefault(n, [])
        while todo:
            fits = np.flatnonzero((room[:n_groups] >= item).all(axis=1))
            if len(fits):
                share, own = room[fits] / caps, item / caps
                score = -(w * (share - own) ** 2).sum(axis=1) if rule == "norm" else (w * share * own).sum(axis=1)
                g = fits[np.argmax(score)]
                left, (base, bins, used) = room[g].copy(), where[g].copy()
                n_groups -= 1
                room[g], where[g] = room[n_groups], where[n_groups]
            else:  # as many new bins as these items need
                left, used, base = caps.copy(), 0, out.bins
                bins = -(-todo // int((left // item).min()))
                out.bins += int(bins)
            each = int((left // item).min())
            full, rest = divmod(min(todo, bins * each), each)
            if full:
                rows.append((rank, base, each, used))
                add(left - item * each, base, full, used + n * each)
            if rest:
                rows.append((rank + full * each, base + full, each, used))
                add(left - item * rest, base + full, 1, used + n * rest)
            taken = full + bool(rest)
            if taken < bins:
                add(left, base + taken, bins - taken, used)
            rank += full * each + rest
            todo -= full * each + rest
    out.left += [(int(w[0]), int(w[1]), *map(int, r)) for r, w in zip(room[:n_groups], where[:n_groups], strict=True)]
    out.left.sort()
    return out


LEFT = ("tokens_left", "documents_left", "attention_left")


def pack(pieces: DataFrame, capacity: int = 1024, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """Add sequence_id, offset, and what the sequence leaves: tokens_left, documents_left, attention_left. pieces: a written table as tokenize() makes it (it is read twice, and part and place must not change)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = write_shared(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity, documents, attention, weights, rule)
    ranges, left = made.arrays(), np.array(made.left, np.int64).reshape(-1, 5)  # some ranges for each length: bounded by the capacity
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "part", "place")

    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                r = ranges[n]
                own = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
                k = rank[at] - own[:, 0]
                seq[at], off[at] = own[:, 1] + k // own[:, 2], own[:, 3] + k % own[:, 2] * n
            room = left[np.searchsorted(left[:, 0], seq, "right") - 1] if len(seq) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off), *(pa.array(room[:, i].copy()) for i in (2, 3, 4))], names=[*names, "sequence_id", "offset", *LEFT])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long, {', '.join(f'{c} long' for c in LEFT)}").drop("rank")


def pack_documents(docs: DataFrame, key: str, text: str, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, keep_ids: bool = False, **capacities) -> DataFrame:
    """key, piece, start, length, ids_crc32 [, ids], sequence_id, offset and what is left, of every piece."""
    pieces = write_shared(tokenize(docs, key, text, path, ranks, pattern, capacity, keep_ids), "pieces")
    return pack(pieces, capacity, **capacities)
