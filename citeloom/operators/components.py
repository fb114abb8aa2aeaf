"""Connected components by alternating stars (large-star, small-star; Kiveris et al. 2014).

Every node ends as a neighbour of the least node of its component. A round is two
aggregations, each joined back to the edges, so that a hub's edges are never gathered
in one group; rounds are written to the shared folder. The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.tables import discard, written

ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the least id reachable) of every node of an edge; loops make a component of one.

    Null ends are ignored. Ids may be of any ordered type.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = ends.filter(F.col("a") == F.col("b")).select("a").distinct()
    now = written(ends.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", free=False)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: a node's greater neighbours move to the least of its neighbours and itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(small, "edges", free=False)
        discard(before)
        # done when every node has one edge, and none that it leads to has one itself
        n = now.agg(F.count("*").alias("edges"), F.count_distinct("a").alias("nodes")).first()
        if n["edges"] == n["nodes"] and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct()
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
    rest = alone.select(F.col("a").alias("id")).join(found.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    return found.unionByName(rest)
