"""Relations of the engine, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.sources.markup import page_index
from citeloom.schema import AUTHOR, CITER, REFERENCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(kind: str):
    return F.lit(None).cast(kind)


def _work(**own) -> list:
    kinds = {
        **dict.fromkeys("_id type title original_title container_title container_title_short collection_title volume issue page page_first DOI publisher publisher_place abstract pdf kind source format created modified fetched deleted cluster visited".split(), "string"),
        "ISSN": "array<string>", "URL": "array<string>", "author": f"array<{AUTHOR}>", "issued": "struct<year: bigint, month: bigint, day: bigint>", "is_referenced_by": f"array<{CITER}>", "reference": f"array<{REFERENCE}>",
    }
    return [own.get(k, F.lit("work") if k == "kind" else _null(t)).cast(t).alias(k) for k, t in kinds.items()]


def works_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works from orders and their customers: blocks by year, month as volume, customer as page; a cluster is a block's least id."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ident = F.concat(F.lit("urn:o:"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    block = Window.partitionBy(F.year("o_orderdate"), F.month("o_orderdate"), "o_custkey")
    last = F.col("o_custkey") + F.col("o_orderkey") % 20
    author = F.array(F.struct(F.col("c_name").alias("family"), F.col("c_mktsegment").alias("given"), F.when(F.col("c_name") == "", F.col("c_name")).alias("literal")))
    return o.select(
        *_work(
            _id=ident,
            type=F.when(F.col("o_orderstatus") == "F", "article-journal").when(F.col("o_orderstatus") == "O", "book").otherwise("chapter"),
            title=F.concat(F.lit("Order "), F.col("o_orderpriority")),
            container_title=F.col("c_mktsegment"),
            volume=F.month("o_orderdate"),
            issue=F.col("o_orderstatus"),
            page=F.concat(F.col("o_custkey").cast("string"), F.lit("-"), last.cast("string")),
            page_first=F.col("o_custkey"),
            author=author,
            issued=F.struct(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month"), F.day("o_orderdate").cast("bigint").alias("day")),
            source=F.col("o_orderpriority"),
            cluster=F.min(ident).over(block),
        )
    )


def works_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works from documents: the whole text is the title, its digest stands for the DOI, so copies share a block."""
    d = table(spark, sf_dir, "documents").withColumn("_md5", F.md5(F.col("text")))
    ident = F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    # An aggregation and a join, which Spark can split, in place of a window over a crowd of copies.
    least = d.groupBy(F.col("_md5").alias("_of")).agg(F.min(ident).alias("_least"))
    d = d.join(least, F.col("_md5").eqNullSafe(F.col("_of")))
    return d.select(
        *_work(
            _id=ident,
            type=F.lit("article-journal"),
            title=F.col("text"),
            container_title=F.col("source"),
            volume=F.col("lang"),
            page=F.col("n_chars"),
            DOI=F.upper("_md5"),
            source=F.col("source"),
            cluster=F.col("_least"),
        )
    )


def names_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal names from parts: id, raw, issn."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("raw"), F.col("p_brand").alias("issn"))


def names_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal names: id, raw, issn. From the titles of pages (their host stands for the ISSN), and from parts: words made of their names, the first two in
    either order, and their types."""
    titles = page_index(table(spark, sf_dir, "pages").withColumn("issn", F.regexp_extract("url", "://([^/?#]+)", 1)).select(F.struct("page_id", "issn").alias("key"), "html"), "key")
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("id"), F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", one, two)).otherwise(F.concat_ws(" ", two, one)), F.concat(one, F.lit("ish")), F.concat(two, F.lit("ics")), F.concat(one, two), F.concat(two, one), F.lower("p_type")).alias("raw"), F.col("p_brand").alias("issn"))
    return titles.select(F.col("key.page_id").cast("long").alias("id"), F.coalesce("title", F.lit("")).alias("raw"), F.nullif("key.issn", F.lit("")).alias("issn")).unionByName(parts)


def coverage_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage from labels of documents."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("cluster_id"), F.col("source").alias("cid"), F.col("lang").alias("title"), F.lit("").alias("query"), _null("string").alias("match_id"), _null("string").alias("match_name"),
        F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("matched"), F.lit("2024-01-01").alias("checked"),
    )


def queue_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue from events: the last visit of every customer, null for those unseen."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    rows = table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("scope"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("visited"))


def votes_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from line items: for each part, return flags in an order that is total up to equal votes."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber")
