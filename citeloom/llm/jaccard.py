"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles, as 64-bit hashes. Equal sets are one class, known by two 64-bit
hashes of the set and its size; the first is the class's name, but for the few classes that share one (they get another).
The global order of shingles puts those that are not frequent first (by hash), then the frequent ones from
rare to common; "frequent" rests on counts over all documents.

Candidates: two sets that are similar enough share a shingle among the first few of both in that order (prefix
filter), at places that still allow the overlap (positional filter), and their sizes are close. Then parity signatures, with at least
two bits a shingle, bound the overlap from above: two signatures differ in at most as many bits as the sets differ in
shingles. What passes is nearly always a link.

Counting: the global order is cut into fragments, and the sets of candidates into segments, one for each fragment. A segment
goes to the task of its fragment, where it meets the segment of the class that it is a candidate with; overlaps are counted there,
fragment by fragment, and the counts are summed per pair. A pair links when ``100 * overlap >= percent * union``. Of a pair, the class
with more candidates leads; its segments are sent once for up to ``MEMBERS`` of its candidates, so that a class with very many of
them is spread over tasks.

Crowded prefix shingles (with more than ``CROWD`` classes): the rows of a very frequent one are dealt over salted groups of some
``HOT`` rows. In a group, every class is paired with the two that have least of their own in front of the shingle (in a crowd of near
copies those are nearest to what was copied), and so are the leaders of the groups. What that leaves in different components of
the same crowd is then paired in full, so that no link is lost: in cells of some ``CELL`` rows, members of the largest component
with those of others, and these among each other, where short signatures allow it.

Defined results: null and empty texts have no set and link with nothing; fewer words than a
shingle's make one shingle of all; repeated rows are one class. Rows without a key are kept: they link like others, their component
is the least key reachable, or null. An empty table has an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import discard, fresh, slices, text_of, write_shared
from citeloom.llm.hashing import BASE, Prefixes, mixed
from citeloom.operators.components import connected_components

CROWD, HOT, CELL, MEMBERS = 8, 4096, 2048, 1024
#: At most so many frequent shingles are told apart, the commonest; they are sent to all tasks (16 bytes each). What is linked does not depend on it.
FREQUENT = 1 << 17
#: A shingle is offered as frequent by a part of a batch (OFFERED bytes of text) that has it in so many documents.
OFFER, OFFERED = 2, 8 << 20
#: Parts of the global order: all but the last share what is not frequent, the last has what is.
FRAGMENTS = 5
CHUNK = 1 << 19
#: Bytes of a short signature.
BRIEF = 32

_PLACES = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of every run of bytes that are not white space."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return begin, Prefixes(data).ranges(begin, end)


def shingle_sets(texts: Sequence[str], n: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingles of every text, as sorted 64-bit hashes; A-Z are lower-cased."""
    at = 0
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) < CHUNK):
            size += len(raw[to]) + 1
            to += 1
        part = raw[at:to]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        begin, words = word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in part])
        upto = np.searchsorted(begin, ends)
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            grams += words[k : k + len(grams)] * _PLACES[k % len(_PLACES)] * np.uint64(2 * (k // len(_PLACES)) + 1)
        grams = mixed(grams)
        first = 0
        for last in upto.tolist():
            count = last - first
            if count >= n:
                yield np.unique(grams[first : last - n + 1])
            elif count:
                few = np.uint64(count)
                for k in range(count):
                    few = few * BASE + words[first + k]
                yield mixed(np.array([few], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            first = last
        at = to


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        size = np.uint64(len(s))
        sums = (mixed(s * _PLACES[0]).sum(dtype=np.uint64), mixed(s ^ _PLACES[3]).sum(dtype=np.uint64))
        return tuple(mixed(np.array([x + size * p for x, p in zip(sums, _PLACES[1:3], strict=True)], np.uint64)).view(np.int64).tolist()) if len(s) else (0, 0)


def least_overlap(na, nb, percent: int):
    """The least overlap of two sets of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def signature(s: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of so many places: a power of two, twice as many as shingles at least."""
    places = max(8 * BRIEF, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 8 * BRIEF
    counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature as one of fewer bytes has it."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def differ(one: bytes, two: bytes) -> int:
    """In how many bits two signatures differ; at most as many as the sets differ in shingles."""
    size = min(len(one), len(two))
    return int(np.bitwise_count(folded(np.frombuffer(one, np.uint8), size) ^ folded(np.frombuffer(two, np.uint8), size)).sum())


def _quiet() -> None:
    np.seterr(over="ignore")


class Order:
    """The global order of shingles. frequent: from rare to common, with the number of documents of each."""

    def __init__(self, frequent: np.ndarray, docs: np.ndarray):
        self.frequent, self.docs = frequent, docs

    @cached_property
    def _by_hash(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.frequent)
        marks = np.zeros(1 << 20, bool)
        marks[(self.frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return self.frequent[order], order, marks

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles that are not frequent, by hash, and the places of the others among the frequent ones, rare first."""
        known, order, marks = self._by_hash
        maybe = np.flatnonzero(marks[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return s, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
        is_known = known[at] == s[maybe]
        return np.delete(s, maybe[is_known]), np.sort(order[at[is_known]])

    def segments(self, s: np.ndarray) -> list[np.ndarray]:
        """The set's part in every fragment."""
        light, common = self.split(s)
        bounds = np.array([(k << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)], np.uint64)
        return [*np.split(light, np.searchsorted(light, bounds)), np.sort(self.frequent[common])]


SETS = "kind int, row long, missing boolean, mark long, s long, t long, size int, bits binary, brief binary"


def describe_sets(rows: DataFrame, n: int) -> DataFrame:
    """kind 0: a row (row, missing, mark), both hashes of its set, its size and signatures; kind 1: a shingle (s) and in how many documents one part of a batch has it (t)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        names = ["kind", "row", "missing", "mark", "s", "t", "size", "bits", "brief"]
        for b in batches:
            for part in slices(b, 3, OFFERED):
                sets = [s for some in slices(part, 3, CHUNK) for s in shingle_sets(some.column(3).to_pylist(), n)]
                k = len(sets)
                one, two = np.array([set_hashes(s) for s in sets], np.int64).reshape(-1, 2).T
                bits = [signature(s) for s in sets]
                brief = [folded(np.frombuffer(x, np.uint8), BRIEF).tobytes() for x in bits]
                sizes = pa.array(np.array([len(s) for s in sets], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), *part.columns[:3], pa.array(one), pa.array(two), sizes, pa.array(bits, pa.binary()), pa.array(brief, pa.binary())], names=names)
                h, count = np.unique(np.concatenate(sets), return_counts=True)
                many = count >= OFFER
                k = int(many.sum())
                zero, none = pa.array(np.zeros(k, np.int64)), pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), zero, pa.array(np.zeros(k, bool)), zero, pa.array(h[many].view(np.int64)), pa.array(count[many].astype(np.int64)), pa.array(np.zeros(k, np.int32)), none, none], names=names)

    return rows.mapInArrow(describe, SETS)


PREFIX = "h long, salt int, s long, size int, place int"


def prefixes(rows: DataFrame, n: int, percent: int, order: Order, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """The first shingles of every set in the global order. salt: of a frequent shingle from 1 on. rows: text."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        seen: set[int] = set()
        salts = 1 + order.docs // HOT
        for b in batches:
            for part in slices(b, 0, CHUNK):
                hs, qs, ss, ns, ps = [], [], [], [], []
                for s in shingle_sets(part.column(0).to_pylist(), n):
                    hashes = set_hashes(s)
                    if not (size := len(s)) or (own := renamed.get(hashes, hashes[0])) in seen:
                        continue
                    if len(seen) < 1 << 16:  # copies in one task go out once; the join does not depend on it
                        seen.add(own)
                    take = size - -(-percent * size // 100) + 1
                    light, common = order.split(s)
                    light = light[:take]
                    common = common[: take - len(light)]
                    hs += [light, order.frequent[common]]
                    qs += [np.zeros(len(light), np.int32), np.where(salts[common] > 1, 1 + own % salts[common], 0).astype(np.int32)]
                    many = len(light) + len(common)
                    ss.append(np.full(many, own, np.int64))
                    ns.append(np.full(many, size, np.int32))
                    ps.append(np.arange(many, dtype=np.int32))
                if hs:
                    columns = [pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (qs, ss, ns, ps))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "salt", "s", "size", "place"])

    return rows.mapInArrow(first, PREFIX)


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays; short signatures as rows of words."""
    out = {}
    for name, c in zip(b.schema.names, b.columns, strict=True):
        if name == "brief":
            whole = pc.cast(c, pa.binary(BRIEF))
            out[name] = np.frombuffer(whole.buffers()[1], np.uint64)[whole.offset * BRIEF // 8 : (whole.offset + len(whole)) * BRIEF // 8].reshape(-1, BRIEF // 8)
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def _runs(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole groups of rows that agree in ``by``, some at a time, and where each begins. The input is sorted."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def joined() -> tuple[dict[str, np.ndarray], np.ndarray]:
        x = held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        return x, _starts(x, by)

    for b in batches:
        if not b.num_rows:
            continue
        x = _columns(b)
        starts = _starts(x, by)
        cut = int(starts[-1])
        if held and (len(starts) > 1 or last != tuple(x[c][0] for c in by)):
            held.append({c: v[:cut] for c, v in x.items()})
            yield joined()
            held = []
        elif cut:
            held = [{c: v[:cut] for c, v in x.items()}]
            yield joined()
            held = []
        held.append({c: v[cut:] for c, v in x.items()})
        last = tuple(x[c][-1] for c in by)
    if held:
        yield joined()


def _starts(x: dict[str, np.ndarray], by: Sequence[str]) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], np.any([x[c][1:] != x[c][:-1] for c in by], axis=0)))) if len(x[by[0]]) else np.zeros(0, np.int64)


def _possible(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int, placed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows whose sizes (places, short signatures) allow a link."""
    ni, nj = x["size"][i].astype(np.int64), x["size"][j].astype(np.int64)
    least = least_overlap(ni, nj, percent)
    ok = (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj)) & (x["s"][i] != x["s"][j])
    if placed:
        ok &= np.minimum(ni - x["place"][i], nj - x["place"][j]) >= least
    if "brief" in x:
        i, j, least, both = i[ok], j[ok], least[ok], (ni + nj)[ok]
        ok = both - np.bitwise_count(x["brief"][i] ^ x["brief"][j]).sum(axis=1, dtype=np.int64) >= 2 * least
    return i[ok], j[ok]


#: Rows of the first meeting. kind 0: a pair (a, b and their sizes); 1: a member of a crowd (shingle, class, size, place); 2: a leader of a salted group, likewise.
MET = "kind int, a long, b long, na int, nb int"


def _met(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), a, b, na.astype(np.int32), nb.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["kind", "a", "b", "na", "nb"])


def _pairs(x: dict[str, np.ndarray], i: list, j: list) -> Iterator[pa.RecordBatch]:
    """Pairs of rows as kind 0, the lesser class first, each once."""
    if i and sum(map(len, i)):
        i, j = np.concatenate(i), np.concatenate(j)
        swap = x["s"][i] > x["s"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        yield _met(0, *np.unique(np.stack([x["s"][i], x["s"][j], x["size"][i].astype(np.int64), x["size"][j].astype(np.int64)]), axis=1))


def meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a prefix shingle; of crowds, only some, and the crowds' members. rows: as of prefixes()."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _runs(batches, ("h", "salt")):
            same = np.concatenate(([False], (x["h"][1:] == x["h"][:-1]) & (x["s"][1:] == x["s"][:-1])))
            x = {c: v[~same] for c, v in x.items()}
            starts = _starts(x, ("h", "salt"))
            sizes = np.diff(np.concatenate((starts, [len(x["h"])])))
            crowded = (sizes > CROWD) | (x["salt"][starts] > 0)
            left, right = [], []
            for size in np.unique(sizes[sizes > 1]).tolist():
                for crowd in (False, True):
                    at = starts[(sizes == size) & (crowded == crowd)]
                    if not crowd:
                        i, j = np.triu_indices(size, 1)
                        got = _possible(x, (at[:, None] + i).ravel(), (at[:, None] + j).ravel(), percent)
                    else:  # with the two that have least of their own before the shingle they share
                        i = np.concatenate([np.repeat(at, size - 1), np.repeat(at + 1, size - 1)])
                        got = _possible(x, i, np.tile((at[:, None] + np.arange(1, size)).ravel(), 2), percent, placed=False)
                    left.append(got[0])
                    right.append(got[1])
            yield from _pairs(x, left, right)
            member = np.repeat(crowded, sizes)
            if member.any():
                salted = starts[x["salt"][starts] > 0]
                second = salted + 1
                leaders = np.concatenate((salted, second[(second < len(x["h"])) & ~np.isin(second, starts)]))
                for kind, own in ((1, np.flatnonzero(member)), (2, leaders)):
                    yield _met(kind, x["h"][own], x["s"][own], x["size"][own], x["place"][own])

    return rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "place", "size", "s").mapInArrow(find, MET)


def members(met: DataFrame, kind: int) -> DataFrame:
    return met.filter(F.col("kind") == kind).select(F.col("a").alias("h"), F.col("b").alias("s"), F.col("na").alias("size"), F.col("nb").alias("place"))


def cells(crowd: DataFrame) -> DataFrame:
    """Deal the members of crowds over cells: rows of side 0 meet those of side 1 of their cell, and each other where the cell is a diagonal one.

    Those of a crowd's largest component are dealt over cells as side 1; every other member goes to each of these as side 0, and to the
    cells of pairs of blocks of others. crowd: h, s, size, place, component.
    """
    by = crowd.groupBy("h", "component").agg(F.count("*").alias("n"))
    of = by.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_rest")).filter("n_rest > 0")
    of = of.select("h", "main", F.ceil(F.col("n_main") / CELL).cast("int").alias("mains"), F.ceil(F.col("n_rest") / CELL).cast("int").alias("rests"))
    rows = crowd.join(of, "h")
    block = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = block("rests")
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: cell(F.lit(-1), k, 0)),
        F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.when(k < own, cell(k, own, 1)).otherwise(cell(own, k, 0))),
    )
    to = F.when(F.col("component") == F.col("main"), F.array(cell(F.lit(-1), block("mains"), 1))).otherwise(others)
    return rows.withColumn("cell", F.explode(to)).select("h", "cell.i", "cell.j", "cell.side", "s", "size", "place", "component")


def cross(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a crowd's members that are in different components so far. rows: as of cells(), with their short signatures."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, starts in _runs(batches, ("h", "i", "j")):
            left, right, held = [], [], 0
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x["h"])], strict=True):
                middle = lo + int(np.searchsorted(x["side"][lo:hi], 1))
                for i in range(lo, middle):
                    j = np.arange(i + 1 if x["i"][lo] == x["j"][lo] else middle, hi)
                    j = j[x["component"][j] != x["component"][i]]
                    if len(j):
                        got = _possible(x, np.full(len(j), i), j, percent)
                        left.append(got[0])
                        right.append(got[1])
                        held += len(got[0])
                    if held > 1 << 18:
                        yield from _pairs(x, left, right)
                        left, right, held = [], [], 0
            yield from _pairs(x, left, right)

    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side").mapInArrow(find, MET)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow a link. classes: name, size, bits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 4, CHUNK):
                na, nb = (part.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                apart = np.array([differ(x, y) for x, y in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)], np.int64)
                ok = pa.array(na + nb - apart >= 2 * least_overlap(na, nb, percent))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    of = lambda c: classes.select(F.col("name").alias(c), F.col("size").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def packed_texts(rows: DataFrame) -> DataFrame:
    """row, missing, mark, packed: the texts, compressed; a text that one task has again under the same id goes out once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        seen: set[tuple] = set()
        for b in batches:
            for part in slices(b, 3, CHUNK):
                at = []
                for i, own in enumerate(zip(*(c.to_pylist() for c in part.columns[:3]), strict=True)):
                    if own not in seen:
                        at.append(i)
                        if len(seen) < 1 << 16:
                            seen.add(own)
                part = part.take(pa.array(at, pa.int32()))
                packed = pa.array([packer.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["row", "missing", "mark", "packed"])

    return rows.mapInArrow(pack, "row long, missing boolean, mark long, packed binary")


SEGMENTS = "lead long, salt int, fragment int, s long, n int, segment binary"


def segments(needed: DataFrame, n: int, order: Order) -> DataFrame:
    """The segments of classes, for each pair they are in. needed: s, lead, salt (of a leader: the number of salts), packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        unpack = zstandard.ZstdDecompressor()
        names = ["lead", "salt", "fragment", "s", "n", "segment"]
        last, own, size = None, [], 0
        for b in batches:
            for part in slices(b, 3, CHUNK // 8):
                out, held = [], 0
                for s, lead, salt, packed in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if s != last:
                        whole = next(shingle_sets([unpack.decompress(packed).decode("utf-8", "surrogatepass")], n))
                        last, size = s, len(whole)
                        own = [(f, x.tobytes()) for f, x in enumerate(order.segments(whole)) if len(x)]
                    for k in range(salt) if s == lead else (salt,):
                        out += [(lead, k, f, s, size, x) for f, x in own]
                        held += 8 * size
                        if held > CHUNK * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)

    return needed.select("s", "lead", "salt", "packed").mapInArrow(cut, SEGMENTS)


KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())


def partial_overlaps(parts: DataFrame) -> DataFrame:
    """a, b, na, nb, fragment, common: the overlap in one fragment of each pair that has one there. parts: as of segments()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, size = None, np.zeros(0, np.uint64), 0
        for b in batches:
            rows = []
            for hub, salt, fragment, s, n, segment in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(segment, np.uint64)
                if s == hub:
                    at, lead, size = (hub, salt, fragment), own, n
                elif at == (hub, salt, fragment):
                    place = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    if common := int((lead[place] == own).sum()):
                        rows.append((hub, s, size, n, common) if hub < s else (s, hub, n, size, common))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "na", "nb", "common"])

    dealt = parts.repartition("lead", "salt", "fragment").sortWithinPartitions("lead", "salt", "fragment", F.col("s") != F.col("lead"), "s")
    return dealt.mapInArrow(count, "a long, b long, na long, nb long, common long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, order: Order) -> DataFrame:
    """The pairs that link: overlaps are counted in each fragment on its own and summed per pair. pairs: a, b. texts: s, packed; one row for each class."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    of = lambda c: degree.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"))
    a_leads = F.col("n_a") >= F.col("n_b")
    led = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("s"), F.ceil(F.greatest("n_a", "n_b") / MEMBERS).cast("int").alias("salts"))
    led = write_shared(led, "led", free=False)
    leads = led.groupBy("lead").agg(F.max("salts").alias("salt")).select(F.col("lead").alias("s"), "lead", "salt")
    needed = led.select("s", "lead", F.pmod(F.xxhash64("s"), "salts").cast("int").alias("salt")).unionByName(leads)
    counts = partial_overlaps(segments(texts.join(needed, "s").select("s", "lead", "salt", "packed").sortWithinPartitions("s"), n, order))
    summed = counts.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def frequent_shingles(offered: DataFrame) -> Order:
    """The global order. offered: s, docs. The least count that leaves at most FREQUENT shingles is found on a histogram, in steps of a 16th of a power of two."""
    counts = write_shared(offered.groupBy("s").agg(F.sum("docs").alias("docs")).withColumn("step", F.floor(F.log2("docs") * 16).cast("int")), "offered", free=False)
    least, total = 1 << 30, 0
    for r in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 16 x 64 rows
        if (total := total + r["n"]) > FREQUENT:
            break
        least = r["step"]
    rows = sorted((r["docs"], r["s"]) for r in counts.filter(F.col("step") >= least).collect())
    discard(counts)
    return Order(np.array([s for _, s in rows], np.int64).view(np.uint64), np.array([n for n, _ in rows], np.int64))


def texts_of(rows: DataFrame, classes: DataFrame, pairs: DataFrame, many: bool) -> DataFrame:
    """s, packed: a text of each class of the pairs, as a written table. many: the classes grow with the rows, so texts and places are shuffled at every size."""
    place = ["row", "missing", "mark"]
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    # As a table of known size: a small one is sent to the texts, and they need not be shuffled.
    needed = write_shared(classes.join(names, "name").select(*place, F.col("name").alias("s")), "needed", free=False)
    found = packed_texts(rows).join(needed.hint("merge") if many else needed, place).dropDuplicates(place)
    return write_shared(found.select("s", "packed"), "texts", codec="none")


def identity(key: str, text: str) -> dict[str, Column]:
    """What a row is found again by: its id, whether that is missing, and a hash of its text, as ids may be missing or come again with another text."""
    k = F.col(key).cast("long")
    return {"row": F.coalesce(k, F.lit(0)), "missing": k.isNull(), "mark": F.xxhash64(text_of(F.col(text)))}


def _grouped(df: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """row, missing, mark, s, t, size of every row; and of every class s, t, size, one (the first row's identity), least, c (the name of its component)."""
    rows = df.select(*(c.alias(name) for name, c in identity(key, text).items()), text_of(F.col(text)).alias("text"))
    described = write_shared(describe_sets(rows, n), "sets")
    order = frequent_shingles(described.filter("kind = 1").select("s", F.col("t").alias("docs")))

    found = described.filter("kind = 0").select("row", "missing", "mark", "s", "t", "size")
    one = [F.min(F.struct("missing", "row", "mark")).alias("one"), F.min(F.when(~F.col("missing"), F.col("row"))).alias("least"), F.first("bits").alias("bits"), F.first("brief").alias("brief")]
    classes = described.filter("kind = 0 AND size > 0").groupBy("s", "t", "size").agg(*one)
    classes = write_shared(classes.select("s", "t", "size", "one.*", "least", "bits", "brief"), "classes", free=False)
    # Of N classes, some N**2 / 2**65 share their first hash: none is expected below a thousand million.
    shared = classes.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1").select("s")
    twins = classes.join(shared, "s").select("s", "t", F.xxhash64("s", "t").alias("name")).collect()
    classes = classes.withColumn("name", F.when(F.col("s").isin([r["s"] for r in twins]), F.xxhash64("s", "t")).otherwise(F.col("s")) if twins else F.col("s"))
    renamed = {(r["s"], r["t"]): r["name"] for r in twins}

    met = write_shared(meet(prefixes(rows.select("text"), n, percent, order, renamed), percent), "met")
    crowd = members(met, 1)
    leaders = meet(members(met, 2).withColumn("salt", F.lit(0)), percent)
    pairs = write_shared(likely(met.unionByName(leaders).filter("kind = 0").select("a", "b").distinct(), classes, percent), "pairs")
    texts = texts_of(rows, classes, pairs, many=True)
    links = write_shared(verified(pairs, texts, n, percent, order), "links")
    grouped = write_shared(connected_components(links), "components", free=False)

    placed = crowd.join(grouped, crowd["s"] == grouped["id"], "left").select("h", "s", "size", "place", F.coalesce("component", "s").alias("component"))
    placed = write_shared(placed, "crowds", free=False)
    dealt = cells(placed).join(classes.select(F.col("name").alias("s"), "brief"), "s")
    rest = cross(dealt, percent).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = write_shared(likely(rest, classes, percent), "rest")
    if not rest.isEmpty():
        more_texts = texts_of(rows, classes, rest, many=False)
        more = verified(rest, more_texts, n, percent, order)
        edges = write_shared(grouped.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "links")
        grouped = write_shared(connected_components(edges), "components")
        discard(edges, more_texts)
    discard(texts, pairs, rest, met, placed, links)

    own = F.struct("missing", "row", "mark").alias("one")
    return found, classes.join(grouped, classes["name"] == grouped["id"], "left").select("s", "t", "size", own, "least", F.coalesce("component", "name").alias("c"))


def join(df: DataFrame, key: str, text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (the least key reachable by links) of every row."""
    found, of_class = _grouped(df, key, text, n, percent)
    least = of_class.groupBy("c").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "c").select("s", "t", "size", "component_id")
    out = found.join(of_class, ["s", "t", "size"], "left")
    own = F.when(~F.col("missing"), F.col("row"))
    return out.select(own.alias(key), F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def one_of_each(df: DataFrame, key: str, text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows, as they are, of which each group of linked ones keeps the one with the least key (one without a key where all are); rows without words all stay."""
    _, of_class = _grouped(df, key, text, n, percent)
    stay = of_class.groupBy("c").agg(F.min("one").alias("one")).select("one.*")
    own = identity(key, text)
    names = fresh(df, *own)
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = df.filter(worded).withColumns(dict(zip(names, own.values(), strict=True)))
    kept = rows.join(stay.select(*(F.col(c).alias(name) for c, name in zip(own, names, strict=True))), names, "left_semi").dropDuplicates(names)
    return kept.select(df.columns).unionByName(df.filter(~worded))
