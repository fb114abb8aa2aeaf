"""CSL-JSON sources: arrays and lines of records, ids, provenance, insert or replace, point and range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.csl import first_or_scalar
from citeloom.schema import AUTHOR, CITER, REFERENCE


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """doc (variant), text, bad of every record of files that hold a JSON array; a file that does not start with '[' is one bad row."""
    files = spark.read.text(path, wholetext=True)
    ok = F.col("value").rlike(r"^\s*\[")
    items = F.from_json(F.when(ok, F.col("value")), "array<variant>")
    # The file's text goes along only where it is the row: behind each of its records, it would make work that grows with the square of the file.
    parsed = files.select(items.alias("items"), "value").select("items", F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, F.col("value")).alias("file"))
    rows = parsed.select(F.explode_outer("items").alias("doc"), "file")
    return rows.select("doc", F.coalesce(F.to_json("doc"), "file").alias("text"), (F.col("doc").isNull()).alias("bad"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc (variant), text, bad of every line; blank lines are skipped, lines that are no object are marked bad."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = lines.select(F.col(column).alias("text")).filter(F.trim("text") != "")
    doc = F.try_parse_json(F.when(F.col("text").rlike(r"^\s*\{"), F.col("text")))
    return rows.select(doc.alias("doc"), "text").withColumn("bad", F.col("doc").isNull())


def record_id(doc: str = "doc", text: str = "text") -> Column:
    """_id, else id unless it is a bare (or pub:) number, else the digest of the record's own text."""
    own = F.expr(f"try_variant_get({doc}, '$._id', 'string')")
    other = F.expr(f"try_variant_get({doc}, '$.id', 'string')")
    return F.coalesce(own, F.when(~other.rlike(r"^(pub:)?\d+$"), other), F.md5(F.col(text)))


def _strings(path: str, doc: str) -> Column:
    """A field that is a string or an array of strings, as an array."""
    at = f"variant_get({doc}, '{path}')"
    return F.expr(f"CASE WHEN schema_of_variant({at}) LIKE 'ARRAY%' THEN from_json(to_json({at}), 'array<string>') WHEN {at} IS NOT NULL THEN array(try_variant_get({doc}, '{path}', 'string')) END")


def _structs(path: str, kind: str, doc: str) -> Column:
    return F.expr(f"from_json(to_json(try_variant_get({doc}, '{path}', 'variant')), 'array<{kind}>')")


def works(docs: DataFrame, source: str, form: str, now: str, doc: str = "doc") -> DataFrame:
    """Works (see citeloom.schema) from parsed records (doc, text); bad ones are left out.

    Records are stamped with their provenance; each starts as its own cluster.
    """
    s = lambda name: first_or_scalar(doc, f'$["{name}"]')
    issued = [F.expr(f"""try_variant_get({doc}, '$.issued["date-parts"][0][{i}]', 'bigint')""") for i in range(3)]
    scalar = F.expr(f"try_variant_get({doc}, '$.issued', 'string')")
    year = F.coalesce(issued[0], F.regexp_extract(scalar, r"^\s*([+-]?\d{1,9})", 1).try_cast("bigint"))
    pdf = F.expr(f"""filter(from_json(to_json(try_variant_get({doc}, '$.link', 'variant')), 'array<struct<`content-type`: string, URL: string>>'), x -> x.`content-type` = 'application/pdf')""")
    ident = record_id(doc)
    return docs.filter(~F.col("bad")).select(
        ident.alias("_id"),
        s("type").alias("type"),
        s("title").alias("title"),
        F.nullif(s("original-title"), F.lit("")).alias("original_title"),
        s("container-title").alias("container_title"),
        s("container-title-short").alias("container_title_short"),
        s("collection-title").alias("collection_title"),
        *(s(c).alias(c) for c in ("volume", "issue", "page")),
        s("page-first").alias("page_first"),
        s("DOI").alias("DOI"),
        _strings("$.ISSN", doc).alias("ISSN"),
        s("publisher").alias("publisher"),
        s("publisher-place").alias("publisher_place"),
        _strings("$.URL", doc).alias("URL"),
        _structs("$.author", AUTHOR, doc).alias("author"),
        F.when(F.coalesce(year, *issued[1:]).isNotNull(), F.struct(year.alias("year"), issued[1].alias("month"), issued[2].alias("day"))).alias("issued"),
        _structs('$["is-referenced-by"]', CITER, doc).alias("is_referenced_by"),
        _structs("$.reference", REFERENCE, doc).alias("reference"),
        s("abstract").alias("abstract"),
        F.get(pdf, F.lit(0))["URL"].alias("pdf"),
        F.lit("work").alias("kind"),
        F.lit(source).alias("source"),
        F.lit(form).alias("format"),
        *(F.lit(now).alias(c) for c in ("created", "modified", "fetched")),
        F.lit(None).cast("string").alias("deleted"),
        ident.alias("cluster"),
        F.lit(None).cast("string").alias("visited"),
    )


def upsert(old: DataFrame, new: DataFrame, force: bool = True, key: str = "_id", order: str = "modified") -> DataFrame:
    """Insert or replace. force: the newest of each key stays, else what was there does; of several new ones, the newest."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"), F.xxhash64(*[c for c, t in new.dtypes if t != "variant"]))
    if not force:
        new = new.join(old.select(key), key, "left_anti")
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


def push(existing: DataFrame, docs: DataFrame, key: str = "_id") -> dict[str, int]:
    """How many documents are new, and how many are in conflict with ids that exist."""
    conflict = docs.join(existing.select(key), key, "left_semi").count()
    return {"ok": docs.count() - conflict, "conflict": conflict}


def by_ids(works_: DataFrame, ids: str | list[str]) -> DataFrame:
    """Records by ids, given as a list or divided by '|' or ','."""
    wanted = [i for i in (ids.replace("|", ",").split(",") if isinstance(ids, str) else ids) if i]
    return works_.filter(F.col("_id").isin(wanted))


def key_range(rows: DataFrame, key: str, value: str, low: int = 0, high: int = 2030, year: str = "year") -> DataFrame:
    """Rows of a composite key: the first part equal, the year in its range."""
    return rows.filter((F.col(key) == value) & F.col(year).between(low, high))


def doi_record(fetched: DataFrame, now: str) -> DataFrame:
    """Fetched CSL (doc, text) as works named by their DOI, lower-cased."""
    w = works(fetched, "doi", "csl", now)
    name = F.concat(F.lit("https://doi.org/"), F.lower("DOI"))
    return w.withColumns({"DOI": F.lower("DOI"), "_id": F.coalesce(name, "_id"), "cluster": F.coalesce(name, "_id")})


def agencies(dois: DataFrame, prefixes: DataFrame, doi: str = "doi") -> DataFrame:
    """Adds the registration agency of each DOI's prefix (prefixes: prefix, agency); null where it is not known yet."""
    keyed = dois.withColumn("prefix", F.split(doi, "/")[0])
    return keyed.join(prefixes, "prefix", "left")


def learned(dois: DataFrame, answers: DataFrame) -> DataFrame:
    """Prefixes that answers (doi, agency) taught."""
    return answers.select(F.split("doi", "/")[0].alias("prefix"), "agency").filter("agency IS NOT NULL").groupBy("prefix").agg(F.min("agency").alias("agency"))


def walk(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Records of all files of that name below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    doc = F.try_parse_json("value")
    return files.select(doc.alias("doc"), F.col("value").alias("text"), doc.isNull().alias("bad"))
