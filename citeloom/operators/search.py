"""Conjunctive title search: postings, BM25, hits collapsed by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import views

K1, B = 1.2, 0.75


def tokens(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_words(q: str) -> list[str]:
    out: list[str] = []
    for w in q.lower().split():
        if w not in out:
            out.append(w)
    return out


def postings(works: DataFrame) -> DataFrame:
    """token, _id, tf, length: the inverted index of titles."""
    rows = views.live(works).select("_id", tokens(F.col("title")).alias("t")).filter(F.size("t") > 0)
    return rows.select("_id", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("token", "_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def search(works: DataFrame, q: str, limit: int | None = 20) -> DataFrame:
    """_id, score of works whose titles have all words of q, best first. limit: of hits, before they are collapsed."""
    wanted = query_words(q)
    index = postings(works)
    size = views.live(works).select(tokens(F.col("title")).alias("t")).filter(F.size("t") > 0).agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean")).first()
    docs, mean = size["docs"], size["mean"] or 1.0
    hits = index.filter(F.col("token").isin(wanted))
    df = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}  # one for each word asked for
    weight = F.lit(0.0)
    for w, n in df.items():
        idf = F.log(F.lit(1 + (docs - n + 0.5) / (n + 0.5)))
        weight = F.when(F.col("token") == w, idf).otherwise(weight)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    found = hits.withColumn("part", part).groupBy("_id").agg(F.sum("part").alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(wanted)).drop("n")
    found = found.filter(F.lit(bool(wanted)))
    return found if limit is None else found.orderBy(F.desc("score"), "_id").limit(limit)


def collapse(hits: DataFrame, works: DataFrame) -> DataFrame:
    """cluster, _id (its own record, if it is among the hits), score (the best), cluster_size (hits of it), best first."""
    rows = hits.join(works.select("_id", "cluster"), "_id")
    rank = F.struct((F.col("_id") != F.col("cluster")).alias("o"), (-F.col("score")).alias("s"), F.col("_id").alias("i"))
    by = rows.groupBy("cluster").agg(F.min_by("_id", rank).alias("_id"), F.max("score").alias("score"), F.count("*").alias("cluster_size"))
    return by.orderBy(F.desc("score"), "cluster")
