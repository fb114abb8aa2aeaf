"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers; a dimension is a term. Candidates are dealt row by row over resident blocks, one for each task; the queries
pass by in small blocks. Each term's weights in a query block, times the term's posting list, are added to a dense score array of a tile of
candidates; terms are taken in panels (a matrix product each), and in 32-bit floats where the vectors' lengths show that no sum can
leave the integers that these hold exactly, else in 64-bit floats, else in 64-bit integers. Of the first tile k are selected by partition;
of later ones only scores above a query's k-th are looked at. The lists of all tiles and blocks are merged.

Every query meets every candidate, but only as blocks: the query set is stated by the caller, and time grows with its size times
that of the candidates. A candidate travels once, a query once for each resident block. Memory of a task: one resident block, one query
block and a tile of scores.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, neither as query nor as candidate;
nor do rows without an id. Shorter vectors count as zero beyond their end, so an empty one scores 0 with all. Repeated rows are
candidates each on its own. Equal scores go to the smaller id; a query never meets rows of its own id. With no candidates or no queries the
result is empty. Scores are 64-bit integers and exact while ``dim * max|component|**2`` stays below 2**63. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that meet at a time: the rows of a score array and of a tile of posting lists.
QUERY_BLOCK, TILE_ROWS = 512, 1024
#: Candidates of a resident block: so many rows, and so many weights (64 MB of 32-bit floats).
RESIDENT, RESIDENT_CELLS = 1 << 18, 1 << 24
#: Terms whose products are added to a score array in one pass over it.
PANEL = 64


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and ints = floor(scale * x) of every usable vector."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("ints"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of integers as rows, zeros behind the shorter ones."""
    sizes, cells = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    dim = max(1, int(sizes.max()))
    if (sizes == dim).all():
        return cells.reshape(-1, dim)
    m = np.zeros((len(sizes), dim), np.int64)
    m[np.arange(dim) < sizes[:, None]] = cells
    return m


def pack(df: DataFrame, rows: int, blocks: int = 0) -> DataFrame:
    """Pieces of at most so many rows: ids and a row-major matrix, as bytes. blocks: the resident blocks that the rows are dealt over in turn."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            ids, whole, out = b.column(0).to_numpy(), matrix(b.column(1)), []
            for first in range(min(max(1, blocks), len(ids))):
                own, m = ids[first :: max(1, blocks)], whole[first :: max(1, blocks)]
                for at in range(0, len(own), rows):
                    part = m[at : at + rows]
                    small = next(t for t in (np.int8, np.int16, np.int64) if t == np.int64 or (np.iinfo(t).min <= part.min() and part.max() <= np.iinfo(t).max))
                    out.append((turn % max(1, blocks), own[at : at + rows].tobytes(), part.shape[1], np.dtype(small).itemsize, part.astype(small).tobytes()))
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE.values(), strict=True)], names=list(PIECE))

    return df.select("id", "ints").mapInArrow(pieces, "block int, ids binary, dim int, width int, cells binary")


PIECE = {"block": pa.int32(), "ids": pa.binary(), "dim": pa.int32(), "width": pa.int32(), "cells": pa.binary()}


def unpacked(ids: bytes, dim: int, width: int, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, {1: np.int8, 2: np.int16, 8: np.int64}[width]).reshape(-1, dim)


def longest(m: np.ndarray) -> float:
    """The greatest length of a row, from above."""
    x = m.astype(np.float64)
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) * (1 + 1e-9)


def kind_for(bound: float) -> type:
    """The narrowest numbers in which integers up to the bound, and so all their sums below it, are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def accumulate(queries: np.ndarray, postings: np.ndarray, kind: type) -> np.ndarray:
    """Scores (queries x rows): the terms' weights times their posting lists are added up, a panel of terms at a time; postings: (terms x rows).

    Every sum on the way is the inner product of some of the terms, thus never longer than the product of the two vectors' lengths: ``kind`` must hold that.
    """
    terms = np.flatnonzero(queries.any(axis=0))
    terms = terms[terms < len(postings)]
    scores = (np.empty if len(terms) else np.zeros)((len(queries), postings.shape[1]), kind)
    for lo in range(0, len(terms), PANEL):
        panel = terms[lo : lo + PANEL]
        lists = postings[panel[0] : panel[-1] + 1] if panel[-1] - panel[0] + 1 == len(panel) else postings[panel]
        weights, lists = queries[:, panel].astype(kind), lists.astype(kind, copy=False)
        if lo:
            scores += weights @ lists
        else:
            np.matmul(weights, lists, out=scores)
    return scores


class Resident:
    """A block of candidates: ids, ascending, and the posting lists (terms x rows) of their tiles."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]]) -> None:
        dim, self.long = max(m.shape[1] for _, m in pieces), max(longest(m) for _, m in pieces)
        ids = np.concatenate([i for i, _ in pieces])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        whole = np.zeros((len(ids), dim), np.result_type(*(m.dtype for _, m in pieces)))
        at = 0
        while pieces:
            own, m = pieces.pop(0)
            whole[at : at + len(own), : m.shape[1]] = m
            at += len(own)
        held = np.float32 if self.long < 2**24 else np.int64
        self.tiles = [np.ascontiguousarray(whole[order[lo : lo + TILE_ROWS]].T, held) for lo in range(0, len(order), TILE_ROWS)]

    def best(self, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of a query, position here and score of the k best rows of every query; no query meets its own id.

        Positions ascend with ids: a later row must score more than the k-th held to come in.
        """
        kind = kind_for(self.long * longest(queries))
        never = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        lo, hi = np.searchsorted(self.ids, qids, "left"), np.searchsorted(self.ids, qids, "right")
        held = [np.zeros(0, np.int64)] * 3
        found, waiting, least = [], 0, np.full(len(qids), never, kind)
        for t, postings in enumerate(self.tiles):
            at = t * TILE_ROWS
            scores = accumulate(queries, postings, kind)
            for j in np.flatnonzero((lo < hi) & (lo < at + scores.shape[1]) & (hi > at)):
                scores[j, max(0, lo[j] - at) : hi[j] - at] = never
            if t == 0 and scores.shape[1] > k:
                kth = np.partition(scores, -k, axis=1)[:, -k]
                j, p = np.nonzero((scores >= kth[:, None]) & (scores > never))
                s = scores[j, p]
            else:
                rows = np.flatnonzero(scores.max(axis=1) > least)
                some = scores[rows]
                flat = np.flatnonzero(some > least[rows, None])
                (j, p), s = divmod(flat, scores.shape[1]), some.ravel()[flat]
                j = rows[j]
            if len(j):
                found.append((j, p + at, s.astype(np.int64)))
                waiting += len(j)
            if waiting > len(qids) * k or (t == 0 and waiting):
                held, least = kept(held, found, k, least, never)
                found, waiting = [], 0
        return kept(held, found, k, least, never)[0] if found else held


def kept(held: list[np.ndarray], found: list[tuple[np.ndarray, ...]], k: int, least: np.ndarray, never: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The k best of what is held and found, by query; and the k-th score of every query that has so many."""
    j, p, s = (np.concatenate(x) for x in zip(held, *found, strict=True))
    order = np.lexsort((p, -s, j))
    j = j[order]
    starts = np.searchsorted(j, np.arange(len(least)))
    rank = np.arange(len(j)) - starts[j]
    top = rank < k
    last = rank == k - 1
    least = np.full_like(least, never)
    least[j[last]] = s[order][last]
    return [j[top], p[order][top], s[order][top]], least


def deal(queries: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """Pieces of candidates (kind 0), then of all queries (kind 1), of every resident block: a task for each."""
    columns = ["block", "kind", "ids", "dim", "width", "cells"]
    c = pack(rows, TILE_ROWS, blocks).withColumn("kind", F.lit(0))
    q = pack(queries, QUERY_BLOCK).withColumn("kind", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # By number: by hash, blocks would share tasks while others have none.
    return c.select(columns).unionByName(q.select(columns)).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query.

    queries, rows: id long, ints array<long> (see integer_vectors).
    """
    n, dim = rows.agg(F.count("*"), F.max(F.size("ints"))).first()
    fit = max(1, min(RESIDENT, RESIDENT_CELLS // max(1, dim or 1)))
    blocks = max(1, -(-n // fit), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TILE_ROWS)))
    met = deal(queries, rows, blocks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pieces, held = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                at, kind, *packed = (c[i].as_py() for c in b.columns)
                if at != block:
                    block, pieces, held = at, [], None
                if kind == 0:
                    pieces.append(unpacked(*packed))
                    continue
                if not pieces and held is None:
                    continue
                if held is None:
                    held, pieces = Resident(pieces), []
                qids, qm = unpacked(*packed)
                j, p, s = held.best(qids, qm, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[j], held.ids[p], s)], names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(score, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
