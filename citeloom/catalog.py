"""The read API: one method for each route, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import csl as csl_fn
from citeloom.operators import browse, consensus, containers, export, linkage, search, views
from citeloom.sources import csl


class Catalog:
    """Works, container documents and coverage, as one catalogue."""

    def __init__(self, works: DataFrame, container_docs: DataFrame | None = None, coverage: DataFrame | None = None):
        self.works, self.container_docs, self.coverage = works, container_docs, coverage

    def _docs(self) -> DataFrame:
        if self.container_docs is None:
            raise ValueError("this catalogue has no container documents")
        return self.container_docs

    def record(self, id: str) -> DataFrame:
        return csl.by_ids(self.works, [id])

    def records(self, ids: str | list[str]) -> DataFrame:
        return csl.by_ids(self.works, ids)

    def unstructured(self, id: str) -> DataFrame:
        """Plain-text references of the work with this id or DOI."""
        return browse.unstructured(self.works).filter((F.col("_id") == id) | (F.col("doi") == id.lower()))

    def by_doi(self, doi: str) -> DataFrame:
        return views.live(self.works).filter(F.lower("DOI") == csl_fn.clean_doi(F.lit(doi)))

    def cluster(self, id: str) -> DataFrame:
        """The consensus of a cluster."""
        return consensus.consensus(views.live(self.works).filter(F.col("cluster") == id))

    def consensus(self, ids: str | list[str]) -> DataFrame:
        """The consensus of any records, as if they were one cluster."""
        return consensus.consensus(self.records(ids).withColumn("cluster", F.lit("asked")))

    def features(self, a: str, b: str, date_precision: int = 0) -> DataFrame:
        """The feature vector of two records; no row unless both are there."""
        if not isinstance(a, str) or not isinstance(b, str):
            raise ValueError("two ids are needed")
        pair = self.works.sparkSession.createDataFrame([(a, b)], "a string, b string")
        return linkage.compare(pair, self.works, date_precision)

    def container_letters(self) -> DataFrame:
        return views.container_list(self._docs()).groupBy("letter").agg(F.count("*").alias("n")).orderBy("letter")

    def containers(self, letter: str) -> DataFrame:
        rows = self._docs().filter(~F.col("junk")).withColumn("letter", views.text.folded_letter(F.col("name")))
        return rows.filter(F.col("letter") == letter).select("_id", "name", F.size("variants").alias("variants")).orderBy("name")

    def works_by_title(self, title: str) -> DataFrame:
        return browse.by_container(self.works, self.works.sparkSession.createDataFrame([(title,)], "variant string"))

    def works_by_container(self, cid: str) -> DataFrame:
        return browse.by_container(self.works, views.variants(self._docs()).filter(F.col("_id") == cid))

    def resolve(self, variant: str) -> DataFrame:
        return containers.resolve(self.works.sparkSession.createDataFrame([(variant,)], "variant string"), self._docs())

    def author_letters(self) -> DataFrame:
        return views.family_letters(self.works).orderBy("letter")

    def authors(self, letter: str) -> DataFrame:
        return views.family_names(self.works).filter(F.col("letter") == letter).select("family", "n").orderBy("family")

    def works_by_family(self, family: str) -> DataFrame:
        return browse.by_family(self.works, family)

    def volumes(self, year: int) -> DataFrame:
        return browse.volumes(self.works, year).select("volume").orderBy("volume")

    def works_by_volume(self, year: int, volume: int) -> DataFrame:
        return browse.by_volume(self.works, year, volume)

    def years(self) -> DataFrame:
        return views.years(self.works).orderBy("year")

    def search(self, q: str, limit: int = 20) -> DataFrame:
        return search.collapse(search.search(self.works, q, limit), self.works)

    def export(self, envelope: DataFrame, form: str = "ris") -> DataFrame:
        """The representatives of an envelope, in export order."""
        return export.export(self.works.join(envelope.select("_id").distinct(), "_id", "left_semi"), form)

    def coverage_status(self, cid: str | None = None) -> DataFrame:
        from citeloom.operators import coverage

        if self.coverage is None:
            raise ValueError("this catalogue has no coverage")
        rows = views.live(self.works).filter(F.col("_id") == F.col("cluster")).select(F.col("_id").alias("cluster_id"))
        return coverage.status(rows, self.coverage if cid is None else self.coverage.filter(F.col("cid") == cid))
