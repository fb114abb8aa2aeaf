"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern; a pattern's words can be used up to ``max_repeats`` times, each further time at a
higher cost, so that repetition is convex. Words flow from patterns to the sources they
belong to, and from the sources to their quotas, at least total cost. Then documents are
selected: whole passes over a pattern first, and for the rest of its flow seeded documents.

Only the aggregates come to the driver: a row for each pattern, of which there are at most
as many as ``max_patterns`` (an error beyond). The selection follows a seeded order: the place where a partial pass ends is
found by sums over ever smaller ranges of it, at most 2**STEP for each pattern at a time, and among the documents of the last range;
no source is ever in one task. Then the same is done for what the first document that did not fit has left open, until no document
fits any more.

Defined results: documents without words (null and empty texts) are never taken; a null source is a source of its own, last by
code point; a document is taken wholly or not, once or repeatedly; reruns agree for the same seed. Rows that share an id, and those
without one, are drawn one by one, by their place in the input: over the same files reruns agree on them as well. An empty table
has an empty result. The added columns have the names that are asked for; other columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import fresh, write_shared

WORD = r"[^\x20\x09-\x0D]+"
#: A range of the seeded order is parted into 2**STEP ranges, until it holds at most FEW documents.
STEP, FEW = 8, 256


def words(text: Column) -> Column:
    """Number of words: starts of runs that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[Fraction]:
    """Each source's target: its weight's share of all sizes, at most ``most`` times its own size; the excess goes to the others by weight."""
    target, open_ = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in full or open_:
            target[i] = Fraction(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


class Flow:
    """Min-cost flow by successive shortest paths with potentials, in integers."""

    def __init__(self, n: int):
        self.edges: list[list] = []  # to, capacity left, cost
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.edges))
            self.edges.append([y, c, w])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> None:
        n = len(self.out)
        potential = [0] * n
        while True:
            best, via = [None] * n, [None] * n
            best[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > best[x]:
                    continue
                for e in self.out[x]:
                    y, c, w = self.edges[e]
                    if c and (best[y] is None or d + w + potential[x] - potential[y] < best[y]):
                        best[y], via[y] = d + w + potential[x] - potential[y], e
                        heapq.heappush(heap, (best[y], y))
            if best[t] is None:
                return
            far = max(b for b in best if b is not None)
            potential = [p + (far if b is None else b) for p, b in zip(potential, best, strict=True)]
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.edges[via[x] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def route(patterns: Sequence[tuple[tuple, int]], quota: dict, max_repeats: int) -> list[int]:
    """Words to take of each pattern (its sources, its size), to fill the quotas at least cost of repetition.

    The k-th pass over a pattern costs k**2 a word: all first passes come before any
    second one, and a quota that only some patterns can fill takes those.
    """
    names = sorted({s for members, _ in patterns for s in members}, key=lambda s: (s is None, s))
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    flow = Flow(2 + len(patterns) + len(names))
    tiers = []
    for i, (members, size) in enumerate(patterns):
        tiers.append([flow.add(0, 2 + i, size, (k + 1) ** 2) for k in range(max_repeats)])
        for s in members:
            flow.add(2 + i, at[s], size * max_repeats, 0)
    for s in names:
        flow.add(at[s], 1, quota.get(s, 0), 0)
    flow.run(0, 1)
    return [sum(flow.edges[e ^ 1][1] for e in es) for es in tiers]


def keyed(df: DataFrame, key: str, size: Column, sources: Column, seed: str) -> dict[str, Column]:
    """What a plan is made from and applied to: the size, the pattern's id, and the place in the seeded order (draw, then tie).

    The draw of a row with a key depends on nothing else.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    draw = F.when(F.col(key).isNull(), tie).otherwise(F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    return {"size": size.cast("long"), "id": F.to_json(F.struct(sources.alias("p"))), "draw": draw, "tie": tie}


CUTS = "array<struct<most: bigint, draw: bigint, tie: bigint>>"


def plan_mix(df: DataFrame, key: str, size: Column, sources: Column, quota: Callable[[list], dict], max_repeats: int = 3, seed: str = "mix", max_patterns: int = 4096) -> DataFrame:
    """What to take of each pattern: id, passes, cuts (a row for each pattern).

    sources: an array column, the sources a document belongs to. quota: from the list of
    (pattern, size), the words by source.
    """
    spark = df.sparkSession
    docs = df.select(*(c.alias(n) for n, c in keyed(df, key, size, sources, seed).items()), sources.alias("pattern"))
    docs = write_shared(docs, "mix")
    sums = docs.groupBy("id").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sums = sorted(sums, key=lambda r: r["id"])
    patterns = [(tuple(r["pattern"]), r["size"]) for r in sums]
    flows = route(patterns, quota(patterns), max_repeats)
    passes = {r["id"]: (f // r["size"] if r["size"] else 0) for r, f in zip(sums, flows, strict=True)}
    left = {r["id"]: (f % r["size"] if r["size"] else 0) for r, f in zip(sums, flows, strict=True)}
    # Of the partial pass, by pattern: documents of at most so many words, up to a place in the seeded order.
    cuts: dict[str, list[tuple[int, int, int]]] = {i: [] for i in left}
    while found := _cut(docs, cuts, {i: n for i, n in left.items() if n > 0}):
        for i, (draw, tie, taken) in found.items():
            cuts[i].append((left[i], draw, tie))
            left[i] -= taken
    return spark.createDataFrame([(i, passes[i], cuts[i]) for i in cuts], f"id string, passes long, cuts {CUTS}")


def _chosen(size: Column, draw: Column, tie: Column, cuts: str) -> Column:
    return F.exists(cuts, lambda c: (size <= c["most"]) & ((draw < c["draw"]) | ((draw == c["draw"]) & (tie <= c["tie"]))))


def take(df: DataFrame, plan: DataFrame, key: str, size: Column, sources: Column, seed: str = "mix", names: tuple[str, str] = ("mix_size", "mix_taken")) -> DataFrame:
    """Add the size and the words that the mix takes of each row, by these names; no shuffle."""
    as_size, as_taken = names
    own = keyed(df, key, size, sources, seed)
    held = dict(zip(own, fresh(df, as_size, "id", "draw", "tie"), strict=True))
    planned = dict(zip(("passes", "cuts"), fresh(df, "passes", "cuts"), strict=True))
    plan = plan.withColumnsRenamed(planned).withColumnRenamed("id", held["id"])
    rows = df.withColumns({held[n]: c for n, c in own.items()}).join(F.broadcast(plan), held["id"])  # bound: max_patterns rows of a few cuts
    chosen = _chosen(F.col(held["size"]), F.col(held["draw"]), F.col(held["tie"]), planned["cuts"])
    taken = F.col(held["size"]) * (F.col(planned["passes"]) + chosen.cast("long"))
    return rows.select(*(F.col(c) for c in df.columns), F.col(held["size"]).alias(as_size), taken.alias(as_taken))


def _cut(docs: DataFrame, cuts: dict, need: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """By pattern: the last place, and the words up to it, of the longest run of documents that fits into what is needed.

    Documents that are longer than that, or chosen before, are left out. ``at`` has, for each pattern, the range in which the run ends, as
    the draw's leading bits, and the words before it.
    """
    if not need:
        return {}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(i, n, cuts[i]) for i, n in need.items()], f"id string, most long, cuts {CUTS}")
    pool = docs.select("id", "size", "draw", "tie").join(F.broadcast(plan), "id")  # bound, as are those below: a row for each pattern
    pool = pool.filter((F.col("size") > 0) & (F.col("size") <= F.col("most")) & ~_chosen(F.col("size"), F.col("draw"), F.col("tie"), "cuts")).drop("cuts")
    out: dict[str, tuple[int, int, int]] = {}
    bits, at = 0, dict.fromkeys(need, (0, 0))
    inside: dict[int, dict] = {}
    end = (1 << 63) - 1

    def within(bits: int, at: dict) -> DataFrame:
        ranges = spark.createDataFrame([(i, r, before) for i, (r, before) in at.items()], "id string, range long, before long")
        rows = pool.join(F.broadcast(ranges), "id")
        return rows.filter(F.shiftright("draw", 64 - bits) == F.col("range")) if bits else rows

    while at:
        below = bits + STEP
        by = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = within(bits, at).groupBy("id", "most", "before", F.shiftright("draw", 64 - below).alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("docs")).withColumn("upto", F.col("before") + F.sum("n").over(by))
        over = F.when(F.col("upto") > F.col("most"), F.struct("bin", (F.col("upto") - F.col("n")).alias("before"), "docs"))
        ends = bins.groupBy("id").agg(F.min(over).alias("cut"), F.max("upto").alias("all")).collect()
        at, bits = {}, below
        for r in ends:
            i, cut = r["id"], r["cut"]
            if cut is None:  # all of them fit
                out[i] = (end, end, r["all"])
                continue
            if cut["before"]:
                out[i] = ((cut["bin"] << 64 - bits) - 1, end, cut["before"])
            where = at if cut["docs"] > FEW and bits < 64 else inside.setdefault(bits, {})
            where[i] = (cut["bin"], cut["before"])
    by = Window.partitionBy("id").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, 0)
    for bits, at in inside.items():
        near = within(bits, at).withColumn("upto", F.col("before") + F.sum("size").over(by)).filter(F.col("upto") <= F.col("most"))
        out |= {r["id"]: (r["last"]["draw"], r["last"]["tie"], r["taken"]) for r in near.groupBy("id").agg(F.max(F.struct("draw", "tie")).alias("last"), F.max("upto").alias("taken")).collect()}
    return out
