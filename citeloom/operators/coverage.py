"""Coverage of works in another collection: reconciliation, status, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import csl

BATCH = 20
Matcher = Callable[[list[str]], list[tuple[str, str, float] | None]]


def citations(works: DataFrame) -> DataFrame:
    """cluster_id, title, query of every work; those with nothing to ask for are left out."""
    page = F.coalesce("page", "page_first")
    q = csl.citation_string(F.col("title"), F.col("container_title"), F.col("volume"), page, F.col("issued.year"))
    return works.select(F.col("_id").alias("cluster_id"), "title", q.alias("query")).filter("query <> ''")


def reconcile(asked: DataFrame, matcher: Matcher, cid: str, checked: str) -> DataFrame:
    """Ask a matcher in batches; rows of the coverage table. It returns id, name, score (or None) for each query."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                found = matcher(part["query"].tolist())
                yield part.assign(
                    match_id=[f[0] if f else None for f in found], match_name=[f[1] if f else None for f in found], score=pd.Series([f[2] if f else None for f in found], dtype="float64", index=part.index), matched=[int(f is not None) for f in found]
                )

    out = asked.select("cluster_id", "title", "query").mapInPandas(ask, "cluster_id string, title string, query string, match_id string, match_name string, score double, matched int")
    return out.select("cluster_id", F.lit(cid).alias("cid"), "title", "query", "match_id", "match_name", "score", "matched", F.lit(checked).alias("checked"))


def upsert(old: DataFrame, new: DataFrame, key: str = "cluster_id", order: str = "checked") -> DataFrame:
    """Rows of both; of each key the newest, new ones first among equals."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*old.columns)


def status(works: DataFrame, coverage: DataFrame) -> DataFrame:
    """cluster_id, status: in, gap, or unk (never checked)."""
    both = works.select("cluster_id").join(coverage.select("cluster_id", "matched"), "cluster_id", "left")
    return both.select("cluster_id", F.when(F.col("matched") == 1, "in").when(F.col("matched") == 0, "gap").otherwise("unk").alias("status"))


def summary(coverage: DataFrame) -> DataFrame:
    """By scope: checked, matched, gaps, percent matched (one decimal), least, middle and greatest score."""
    rows = coverage.withColumn("_score", F.when(F.col("matched") == 1, F.col("score")))
    by = rows.groupBy("cid").agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("matched") == 1).alias("matched"),
        F.min("_score").alias("least"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _score DESC)").alias("middle"),  # of two in the middle, the greater
        F.max("_score").alias("greatest"),
        F.max("checked").alias("latest"),
    )
    return by.select("cid", "checked", "matched", (F.col("checked") - F.col("matched")).alias("gaps"), F.round(F.col("matched") * 100 / F.col("checked"), 1).alias("percent"), "least", "middle", "greatest", "latest")


def lowest(coverage: DataFrame, n: int = 5) -> DataFrame:
    """The n matches with least score of each scope."""
    w = Window.partitionBy("cid").orderBy("score", "cluster_id")
    rows = coverage.filter("matched = 1 AND score IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("cid", "place", "cluster_id", "score", "title")


def gaps(coverage: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("cid").orderBy("cluster_id")
    return coverage.filter("matched = 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("cid", "place", "cluster_id", "title")
