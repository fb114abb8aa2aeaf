"""Browsing: envelopes of works by an outer key, page coverage, orders for display and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import csl
from citeloom.operators import views
from citeloom.operators.tables import written

SIMPLE = ["_id", "author", "title", "container_title", "ISSN", "volume", "issue", "page", "issued", "DOI"]


def simplify(works: DataFrame) -> DataFrame:
    """The fields that browsing shows."""
    return works.select(*SIMPLE)


def envelope(works: DataFrame, outer: Column, order: Column | None = None) -> DataFrame:
    """outer, cluster, _id (of its representative), cluster_size (within this outer key only).

    The representative is the work that names the cluster, else the first in order.
    """
    order = F.lit(0) if order is None else order
    rows = works.select(outer.alias("outer"), "cluster", "_id", order.alias("_order")).filter(F.col("outer").isNotNull())
    rank = F.struct((F.col("_id") != F.col("cluster")).alias("other"), F.col("_order").alias("o"), F.col("_id").alias("i"))
    return rows.groupBy("outer", "cluster").agg(F.min_by("_id", rank).alias("_id"), F.count("*").alias("cluster_size"))


def by_container(works: DataFrame, titles: DataFrame) -> DataFrame:
    """Works by year of the journals spelled so (titles: variant). A spelling listed twice counts once."""
    page = csl.start_page(F.col("page_first"), F.col("page"))
    rows = views.live(works).join(titles.select(F.col("variant").alias("container_title")).distinct(), "container_title", "left_semi")
    return envelope(rows.filter(F.col("issued.year").between(0, 2030)), F.col("issued.year"), page)


def by_family(works: DataFrame, family: str) -> DataFrame:
    own = csl.parse_author(F.get("author", F.lit(0)))["family"]
    return envelope(views.live(works).filter(own == family), F.col("issued.year"))


def by_volume(works: DataFrame, year: int, volume: int) -> DataFrame:
    """Works of a volume, by first page."""
    h = views.work_hash(works).filter((F.col("year") == year) & (F.col("volume") == volume))
    return envelope(h.join(works.select("_id", "cluster"), "_id"), F.col("page_first"))


def volumes(works: DataFrame, year: int | None = None) -> DataFrame:
    """Volumes of a year (or of each)."""
    h = views.work_hash(works).select("year", "volume")
    return (h if year is None else h.filter(F.col("year") == year)).distinct()


def members(works: DataFrame) -> DataFrame:
    """The ids of every cluster, sorted."""
    return views.clusters(works).groupBy("cluster").agg(F.array_sort(F.collect_list("_id")).alias("members"))


def citation_counts(works: DataFrame) -> DataFrame:
    """How often a cluster is cited, repeats counted, and by how many distinct works."""
    return views.referenced_by(works).groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("cited_by").alias("distinct"))


def page_coverage(works: DataFrame) -> DataFrame:
    """Each article's place on the ruler of its year and volume, in percent; the ruler starts at page 1.

    Two places are kept as SQL engines round floats: hundredths, to the nearest whole number (F.round(x, 2) would go by x in decimal digits).
    """
    r = csl.page_range(F.col("page"))
    rows = works.select("_id", F.col("issued.year").alias("year"), "volume", r[0].alias("first"), r[1].alias("last")).filter("first IS NOT NULL")
    w = Window.partitionBy("year", "volume")
    rows = rows.withColumns({"lo": F.min("first").over(w), "hi": F.max("last").over(w), "articles": F.count("*").over(w)})
    base = F.least(F.lit(1), F.col("lo"))
    span = F.greatest(F.col("hi") - base, F.lit(1))
    percent = lambda pages: F.round(pages * 100 / span * 100) / 100
    return rows.withColumns({"left": percent(F.col("first") - base), "width": percent(F.col("last") - F.col("first"))})


def page_gaps(works: DataFrame) -> DataFrame:
    """Runs of pages of a year and volume that no article before covers."""
    r = csl.page_range(F.col("page"))
    rows = works.select(F.col("issued.year").alias("year"), "volume", r[0].alias("first"), r[1].alias("last")).filter("first IS NOT NULL")
    w = Window.partitionBy("year", "volume").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.coalesce(F.max("last").over(w), F.lit(0)))
    return rows.filter("first > seen + 1").select("year", "volume", (F.col("seen") + 1).alias("from_page"), (F.col("first") - 1).alias("to_page")).distinct()


def export_order(works: DataFrame) -> list[Column]:
    """Year (missing last), digits of the volume, start page. All ascending, null last."""
    start, _ = csl.export_pages(F.col("page"))
    volume = F.regexp_replace(F.coalesce("volume", F.lit("")), r"\D", "").try_cast("bigint")
    return [F.coalesce("issued.year", F.lit(999999)), F.coalesce(volume, F.lit(0)), F.coalesce(csl.parse_int(start), F.lit(0)), F.col("_id")]


def display_order() -> list[Column]:
    """Volume by its digits, else as a roman numeral, others last; then first page, missing last. All ascending, null last."""
    return [csl.volume_number(F.col("volume")), csl.page_range(F.col("page"))[0], F.col("_id")]


def ranked(works: DataFrame, order: list[Column]) -> DataFrame:
    """_id, place of all works in one order.

    No window spans all rows: works are range-partitioned and sorted, and a work's place is its place in its partition
    after the rows of the partitions before (a row for each partition).
    """
    keys = [f"_k{i}" for i in range(len(order))]
    # the order's columns are named before they are dealt out, so that each is computed once
    rows = works.select("_id", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    by = [F.col(k).asc_nulls_last() for k in keys]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    parts = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("_id", F.spark_partition_id().alias("_part"), at.alias("_at")), "ranked")
    start, before = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        start.append((r["_part"], before))
        before += r["n"]
    offsets = works.sparkSession.createDataFrame(start, "_part int, _start long")
    return parts.join(F.broadcast(offsets), "_part").select("_id", (F.col("_start") + F.col("_at") + 1).cast("int").alias("place"))


def unstructured(works: DataFrame) -> DataFrame:
    """Citing work, key and text of every reference that is plain text."""
    refs = works.select("_id", "DOI", F.explode("reference").alias("r")).filter("r.unstructured IS NOT NULL")
    return refs.select("_id", F.lower("DOI").alias("doi"), F.col("r.key").alias("key"), F.col("r.unstructured").alias("text"))
