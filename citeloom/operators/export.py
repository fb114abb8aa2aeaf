"""Exporters: RIS (three dialects), BibTeX, CSL-JSON, OpenURL, TSV, as text columns of works."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import csl, text
from citeloom.operators.browse import export_order

#: Types of records in each format.
RIS_TYPES = {"article-journal": "JOUR", "article": "JOUR", "book": "BOOK", "chapter": "CHAP", "paper-conference": "CPAPER", "thesis": "THES", "report": "RPRT"}
BIBTEX_TYPES = {"article-journal": "article", "article": "article", "book": "book", "chapter": "incollection", "paper-conference": "inproceedings", "thesis": "phdthesis", "report": "techreport"}
VIEW_TYPES = {"article-journal": "JOUR", "chapter": "CHAP"}
LIBRARY_TYPES = {"article-journal": "JOUR", "book": "BOOK", "chapter": "CHAP"}
TSV_COLUMNS = "guid type title authors container-title issn series volume issue spage epage date url doi publisher publisher-place".split()


def _typed(types: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in types.items():
        out = F.when(F.col("type") == k, F.lit(v)).otherwise(out)
    return out


def _line(tag: str, value: Column) -> Column:
    """One line, or none where the value is missing or empty."""
    v = value.cast("string")
    return F.when(v.isNotNull() & (v != ""), F.array(F.concat(F.lit(f"{tag}  - "), v))).otherwise(F.expr("cast(array() as array<string>)"))


def _lines(tag: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: F.concat(F.lit(f"{tag}  - "), v))


def _year() -> Column:
    return F.when(F.col("issued.year") != 0, F.col("issued.year"))


def ris(typed: bool = True) -> Column:
    """RIS with CR LF. typed: use the record's type (browsing has none, and tells journals by their container)."""
    container = F.coalesce("container_title", F.lit(""))
    default = F.when(container != "", "JOUR").otherwise("GEN")
    start, end = csl.export_pages(F.col("page"))
    parts = [
        _line("TY", _typed(RIS_TYPES, default) if typed else default),
        _lines("AU", csl.author_names(F.col("author"))),
        _line("PY", _year()),
        _line("TI", text.one_line(F.col("title"))),
        _line("JO", text.one_line(container)),
        _line("VL", text.one_line(F.col("volume"))),
        _line("IS", text.one_line(F.col("issue"))),
        _line("SP", start),
        _line("EP", end),
        _line("DO", F.col("DOI")),
        _lines("SN", F.col("ISSN")),
        F.array(F.lit("ER  - ")),
    ]
    return F.concat(F.array_join(F.concat(*parts), "\r\n"), F.lit("\r\n\r\n"))


def ris_view() -> Column:
    """The index view's RIS: fixed order of fields, numeric pages; books are GEN there."""
    ranged = F.col("page").rlike(csl.VIEW_PAGES)
    name = lambda a: F.when((a["family"] != "") & (a["given"] != ""), F.concat(a["family"], F.lit(", "), a["given"])).otherwise(a["literal"])
    parts = [
        _line("TY", _typed(VIEW_TYPES, F.lit("GEN"))),
        _line("ID", F.col("_id")),
        _line("TI", F.col("title")),
        _lines("AU", F.filter(F.transform("author", name), lambda n: n.isNotNull())),
        _line("JO", F.col("container_title")),
        _line("VL", F.col("volume")),
        _line("IS", F.col("issue")),
        _line("SP", F.when(ranged, F.regexp_extract("page", csl.VIEW_PAGES, 1).try_cast("bigint")).otherwise(csl.parse_int(F.col("page")))),
        _line("EP", F.when(ranged, F.regexp_extract("page", csl.VIEW_PAGES, 2).try_cast("bigint"))),
        _line("Y1", F.col("issued.year")),
        _line("DO", F.col("DOI")),
        _lines("UR", F.col("URL")),
        F.array(F.lit("ER  - \n\n")),
    ]
    return F.array_join(F.concat(*parts), "\n")


def ris_library() -> Column:
    """The library's RIS: names as spoken, a bare year as Y1 or a date as PY y/m/d/, the first PDF."""
    start, end = csl.greedy_pages(F.col("page"))
    date = F.col("issued")
    full = F.concat_ws("/", date["year"].cast("string"), date["month"].cast("string"), F.coalesce(date["day"].cast("string"), F.lit("")), F.lit(""))
    parts = [
        _line("TY", _typed(LIBRARY_TYPES, F.when(F.col("type").isNotNull(), "GEN"))),
        _line("TI", F.col("title")),
        _lines("AU", csl.spoken_names(F.col("author"))),
        _line("JO", F.col("container_title")),
        _line("SN", F.get("ISSN", F.lit(0))),
        _line("VL", F.col("volume")),
        _line("IS", F.col("issue")),
        _line("SP", start),
        _line("EP", end),
        _line("Y1", F.when(date["month"].isNull(), date["year"])),
        _line("PY", F.when(date["month"].isNotNull(), full)),
        _line("N2", F.col("abstract")),
        _lines("UR", F.col("URL")),
        _line("DO", F.col("DOI")),
        _line("L1", F.col("pdf")),
        _line("PB", F.col("publisher")),
        _line("PP", F.col("publisher_place")),
        F.array(F.lit("ER  - ")),
    ]
    return F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n"))


def bibtex() -> Column:
    container = F.coalesce("container_title", F.lit(""))
    start, end = csl.export_pages(F.col("page"))
    bare = F.regexp_replace(F.coalesce("_id", F.lit("")), "[^A-Za-z0-9]", "")
    key = F.when(bare != "", bare).otherwise(F.concat(F.lit("ref"), F.substring(F.md5(F.to_json(F.struct("title", "container_title", "volume", "page"))), 1, 8)))
    escaped = lambda c: F.replace(F.replace(text.one_line(c.cast("string")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    field = lambda n, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.array(F.concat(F.lit(f"  {n} = {{"), escaped(c), F.lit("}")))).otherwise(F.expr("cast(array() as array<string>)"))
    parts = [
        field("author", F.array_join(csl.author_names(F.col("author")), " and ")),
        field("title", F.col("title")),
        field("journal", container),
        field("volume", F.col("volume")),
        field("number", F.col("issue")),
        field("pages", F.when(end != "", F.concat(start, F.lit("--"), end)).otherwise(start)),
        field("year", _year()),
        field("doi", F.col("DOI")),
        field("issn", F.array_join(F.coalesce("ISSN", F.expr("cast(array() as array<string>)")), ", ")),
    ]
    kind = _typed(BIBTEX_TYPES, F.when(container != "", "article").otherwise("misc"))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.concat(*parts), ",\n"), F.lit("\n}\n"))


def csl_json() -> Column:
    return F.to_json(F.struct("_id", "type", "author", "title", F.col("container_title").alias("container-title"), "ISSN", "volume", "issue", "page", "issued", "DOI"))


def array_document(records: DataFrame, column: str = "record", most: int | None = None) -> DataFrame:
    """value: the lines of JSON arrays, one array for each partition; written as text, every file is one array.

    most: an array ends after so many records, and the next begins; every file is one array then if files end after one more line than that.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, done = 0, False
        for b in batches:
            out = []
            for r in b.column(0).to_pylist():
                out.append(("," if n else "[") + r)
                n += 1
                if n == most:
                    out.append("]")
                    n, done = 0, True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if n or not done:
            yield pa.RecordBatch.from_arrays([pa.array(["]" if n else "[]"])], names=["value"])

    return records.select(column).filter(F.col(column).isNotNull()).mapInArrow(lines, "value string")


def write_arrays(records: DataFrame, path: str, column: str = "record", most: int = 50_000) -> None:
    """A folder of files that each hold a JSON array of at most so many records: an array is read by one task."""
    array_document(records, column, most).write.option("maxRecordsPerFile", most + 1).text(path)


def openurl(default_type: str | None = None, skip_empty: bool = False) -> Column:
    """The query string of an OpenURL. default_type: for records without one; skip_empty: leave empty values out."""
    kind = F.coalesce("type", F.lit(default_type)) if default_type else F.col("type")
    article = kind.isin("article-journal", "journal-article") if skip_empty else (kind == "article-journal")
    start, end = csl.greedy_pages(F.col("page"))

    def pair(name: str, value: Column) -> Column:
        v = value.cast("string")
        there = v.isNotNull() & (v != "") if skip_empty else v.isNotNull()
        return F.when(there, F.array(F.concat(F.lit(f"{name}="), F.url_encode(v)))).otherwise(F.expr("cast(array() as array<string>)"))

    parts = [
        pair("ctx_ver", F.lit("Z39.88-2004")),
        pair("rft_val_fmt", F.when(article, "info:ofi/fmt:kev:mtx:journal")),
        pair("genre", F.when(article, F.lit("article")).otherwise(kind)),
        pair("rft.atitle", F.when(article, F.col("title"))),
        pair("rft.jtitle", F.when(article, F.col("container_title"))),
        pair("rft.title", F.when(~article, F.col("title"))),
        F.transform(csl.spoken_names(F.col("author")), lambda a: F.concat(F.lit("rft.au="), F.url_encode(a))),
        pair("rft.series", F.col("collection_title")),
        pair("rft.volume", F.col("volume")),
        pair("rft.issue", F.col("issue")),
        pair("rft.spage", start),
        pair("rft.epage", end),
        pair("rft.date", F.col("issued.year")),
        F.transform(F.coalesce("URL", F.expr("cast(array() as array<string>)")), lambda u: F.concat(F.lit("rft_id="), F.url_encode(u))),
        pair("rft_id", F.concat(F.lit("info:doi/"), F.col("DOI"))),
    ]
    return F.array_join(F.concat(*parts), "&")


def tsv() -> Column:
    """The sixteen columns of TSV_COLUMNS; all authors, by ';'."""
    start, end = csl.greedy_pages(F.col("page"))
    cells = {
        "guid": F.col("_id"), "type": F.col("type"), "title": F.trim("title"), "authors": F.array_join(csl.spoken_names(F.col("author")), ";"),
        "container-title": F.trim("container_title"), "series": F.trim("collection_title"), "volume": F.trim("volume"), "issue": F.trim("issue"),
        "spage": start, "epage": end, "date": F.col("issued.year"), "url": F.get("URL", F.lit(0)), "doi": F.col("DOI"),
    }
    return F.concat_ws("\t", *(F.coalesce(cells[c].cast("string"), F.lit("")) if c in cells else F.lit("") for c in TSV_COLUMNS))


def export(works: DataFrame, form: str = "ris") -> DataFrame:
    """_id, record in export order: by year, volume, start page."""
    column = {"ris": ris, "bibtex": bibtex, "bib": bibtex, "csl": csl_json}[form.lower()]()
    return works.orderBy(*export_order(works)).select("_id", column.alias("record"))
