"""Index views: relations of key and value over works and container documents.

Each is a projection, or a grouped count with map-side combine. Only live works
are indexed, but for two views that have no guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import csl, text


def live(works: DataFrame) -> DataFrame:
    """Works that are not deleted."""
    return works.filter((F.col("kind") == "work") & F.col("deleted").isNull())


def _year() -> Column:
    return F.col("issued.year")


def _family() -> Column:
    return csl.parse_author(F.get("author", F.lit(0)))["family"]


def count_by(df: DataFrame, **keys: Column) -> DataFrame:
    """n by keys; rows with an empty or missing key are not indexed."""
    keyed = df.select(*(c.alias(k) for k, c in keys.items()))
    for k, kind in keyed.dtypes:
        keyed = keyed.filter(F.col(k).isNotNull() & (F.col(k) != "") if kind == "string" else F.col(k).isNotNull())
    return keyed.groupBy(*keys).agg(F.count("*").alias("n"))


def doi(works: DataFrame) -> DataFrame:
    return count_by(live(works), doi=F.lower("DOI"))


def work_hash(works: DataFrame) -> DataFrame:
    """_id with year, volume, first page, where volume and page are there; the year is not checked."""
    first = csl.page_first_view(F.col("page_first"), F.col("page"))
    volume = csl.parse_int(F.col("volume"))
    return live(works).select("_id", _year().alias("year"), volume.alias("volume"), first.alias("page_first")).filter("volume IS NOT NULL AND page_first IS NOT NULL")


def container_letters(works: DataFrame) -> DataFrame:
    return count_by(live(works), letter=text.first_letter(F.col("container_title")))


def container_names(works: DataFrame) -> DataFrame:
    return count_by(live(works), letter=text.first_letter(F.col("container_title")), name=F.col("container_title"))


def container_year_page(works: DataFrame) -> DataFrame:
    start = csl.start_page(F.col("page_first"), F.col("page"))
    rows = live(works).select("_id", F.col("container_title").alias("container"), _year().alias("year"), start.alias("spage"))
    return rows.filter("container <> '' AND year <> 0 AND spage <> ''")


def clusters(works: DataFrame) -> DataFrame:
    return live(works).filter(F.col("cluster").isNotNull()).select("cluster", "_id")


def referenced_by(works: DataFrame) -> DataFrame:
    """A row for each citing DOI of a cluster."""
    citers = live(works).select("cluster", F.explode("is_referenced_by").alias("c")).filter("c.DOI IS NOT NULL")
    return citers.select("cluster", F.concat(F.lit("https://doi.org/"), "c.DOI").alias("cited_by"))


def family_letters(works: DataFrame) -> DataFrame:
    return count_by(live(works), letter=text.first_letter(_family()))


def family_names(works: DataFrame) -> DataFrame:
    return count_by(live(works), letter=text.first_letter(_family()), family=_family())


def family_years(works: DataFrame) -> DataFrame:
    return count_by(live(works), family=_family(), year=_year())


def years(works: DataFrame) -> DataFrame:
    return live(works).select(_year().alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def values(works: DataFrame, field: str) -> DataFrame:
    """Counts of a field's values: container_title, title, original_title."""
    return count_by(live(works), value=F.col(field))


def short_titles(works: DataFrame) -> DataFrame:
    return count_by(live(works), title=F.col("container_title"), short=F.col("container_title_short"))


def family_given(works: DataFrame) -> DataFrame:
    a = csl.parse_author(F.get("author", F.lit(0)))
    return count_by(live(works), family=a["family"], given=a["given"])


def odd_containers(works: DataFrame) -> DataFrame:
    """Journal names that do not start with a letter; deleted works too."""
    name = F.col("container_title")
    return works.filter(text.no_letter_first(name)).select(F.substring(name, 1, 1).alias("lead"), name.alias("value"))


def odd_families(works: DataFrame) -> DataFrame:
    return live(works).select(_family().alias("value")).filter(text.no_letter_first(F.col("value"))).select(F.substring("value", 1, 1).alias("lead"), "value")


def sources(works: DataFrame) -> DataFrame:
    """Counts by source; deleted works too."""
    return works.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"))


def stats(works: DataFrame) -> DataFrame:
    """The number of works, and of clusters (works that name their own)."""
    n = live(works).agg(F.count("*").alias("works"), F.count_if(F.col("_id") == F.col("cluster")).alias("clusters"))
    return n.select(F.stack(F.lit(2), F.lit("works"), "works", F.lit("clusters"), "clusters").alias("name", "n"))


def container_list(docs: DataFrame) -> DataFrame:
    """Journals by folded letter, with the number of their spellings."""
    return docs.filter(~F.col("junk") & (F.col("name") != "")).select(text.folded_letter(F.col("name")).alias("letter"), "name", F.size("variants").alias("variants"))


def container_junk(docs: DataFrame) -> DataFrame:
    return docs.filter("junk").select(text.first_letter(F.col("name")).alias("letter"), "name", F.size("variants").alias("variants"))


def variants(docs: DataFrame) -> DataFrame:
    """Spelling to container."""
    return docs.select(F.explode("variants").alias("variant"), "_id")


def manage(docs: DataFrame) -> DataFrame:
    """Run to container, of those not curated."""
    return docs.filter(~F.coalesce("curated", F.lit(False))).select("cluster_run", "_id")


def queue(works: DataFrame, by: str | None = None) -> DataFrame:
    """Works to visit, those never visited first, then the longest ago; by container_title or family, within each."""
    scope = {None: F.lit(None).cast("string"), "container": F.col("container_title"), "family": _family()}[by]
    rows = live(works).select(scope.alias("scope"), "visited", "_id")
    rows = rows if by is None else rows.filter(F.col("scope").isNotNull())
    return rows.orderBy("scope", F.asc_nulls_first("visited"), "_id")
