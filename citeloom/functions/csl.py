"""Accessors of citation records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes between pages in the index views.
VIEW_PAGES = r"(\d+)[-|–−](\d+)"


def parse_int(c: Column) -> Column:
    """Leading digits as a whole number; null without any."""
    return F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint")


def first_or_scalar(variant: str, path: str) -> Column:
    """A field of a variant column that may be a string or an array of strings: the string, or the first one."""
    at = f"variant_get({variant}, '{path}')"
    return F.expr(
        f"CASE WHEN schema_of_variant({at}) LIKE 'ARRAY%' THEN try_variant_get({variant}, '{path}[0]', 'string') "
        f"WHEN schema_of_variant({at}) LIKE 'OBJECT%' THEN NULL ELSE try_variant_get({variant}, '{path}', 'string') END"
    )


def clean_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def parse_author(author: Column) -> Column:
    """family and given; a literal is taken apart at its comma, else before its last word."""
    literal = author["literal"]
    comma, last = r"^(.*),\s*(.*)$", r"^(.*)\s+([^\s]+)$"
    split = (
        F.when(literal.rlike(comma), F.struct(F.regexp_extract(literal, comma, 1).alias("family"), F.regexp_extract(literal, comma, 2).alias("given")))
        .when(literal.rlike(last), F.struct(F.regexp_extract(literal, last, 2).alias("family"), F.regexp_extract(literal, last, 1).alias("given")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given")))
    )
    own = F.struct(author["family"].alias("family"), author["given"].alias("given"))
    return F.when(author["family"].isNull() & literal.isNotNull(), split).otherwise(own)


def page_first_view(page_first: Column, page: Column) -> Column:
    """First page as the index has it: page-first, else the start of a range, else the leading number."""
    ranged = F.regexp_extract(page, VIEW_PAGES, 1).try_cast("bigint")
    own = parse_int(page_first)
    return F.coalesce(F.when(own != 0, own), ranged, parse_int(page))


def page_first_worker(page_first: Column, page: Column) -> Column:
    """First page as the worker has it: a page-first that is there but not a number hides the pages."""
    ranged = F.regexp_extract(page, VIEW_PAGES, 1).try_cast("bigint")
    return F.when(page_first.isNotNull(), parse_int(page_first)).otherwise(F.coalesce(ranged, parse_int(page)))


def start_page(page_first: Column, page: Column) -> Column:
    """Start page for browsing, as a string: page-first, else what stands before the first hyphen."""
    return F.coalesce(page_first, F.split(page, "-")[0])


def export_pages(page: Column) -> tuple[Column, Column]:
    """Start and end as written; empty where missing."""
    p = r"(?U)(\w+)\s*[-\u2010-\u2015]\s*(\w+)"
    has = page.rlike(p)
    start = F.when(page.isNull(), F.lit("")).when(has, F.regexp_extract(page, p, 1)).otherwise(F.trim(page))
    return start, F.when(page.isNotNull() & has, F.regexp_extract(page, p, 2)).otherwise(F.lit(""))


def greedy_pages(page: Column) -> tuple[Column, Column]:
    """Start and end around the last hyphen; the end null without one."""
    has = page.rlike("-")
    return F.when(has, F.regexp_extract(page, "(?s)^(.*)-", 1)).otherwise(page), F.when(has, F.regexp_extract(page, "(?s)^.*-(.*)$", 1))


def page_range(page: Column) -> Column:
    """array(first, last) with abbreviated ends written out (123-45: 123 to 145); null without a number."""
    p = r"(\d{1,18})\s*[-\u2010-\u2015]\s*(\d{1,18})"
    a, b = F.regexp_extract(page, p, 1).try_cast("bigint"), F.regexp_extract(page, p, 2).try_cast("bigint")
    sa, sb = a.cast("string"), b.cast("string")
    short = (b < a) & (F.length(sb) < F.length(sa))
    end = F.when(short, F.concat(F.substr(sa, F.lit(1), F.length(sa) - F.length(sb)), sb).try_cast("bigint")).otherwise(b)
    one = F.regexp_extract(page, r"(\d{1,18})", 1).try_cast("bigint")
    return F.when(page.rlike(p), F.array(a, F.greatest(a, end))).when(page.rlike(r"\d"), F.array(one, one))


def roman(c: Column) -> Column:
    """A roman numeral as a number; 0 for anything else."""
    s = F.upper(F.trim(c))
    value = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for v in kv]), x)

    def add(acc: Column, x: Column) -> Column:
        v = value(x)
        less = v < acc["prev"]
        return F.struct(F.when(less, acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.when(less, acc["prev"]).otherwise(v).alias("prev"))

    total = F.aggregate(F.split(F.reverse(s), ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev")), add)["total"]
    return F.when(s.rlike("^[IVXLCDM]+$"), total).otherwise(F.lit(0))


def volume_number(volume: Column) -> Column:
    """First digits, else a roman numeral, as a sort key; null (last) for others."""
    digits = F.regexp_extract(volume, r"(\d{1,18})", 1).try_cast("bigint")
    r = roman(volume)
    return F.coalesce(digits, F.when(r > 0, r.cast("bigint")))


def author_names(authors: Column) -> Column:
    """'family, given' of every author; the literal of those without a family name."""
    name = lambda a: F.when(a["family"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])).otherwise(a["literal"])
    return F.filter(F.transform(F.coalesce(authors, F.expr("cast(array() as array<struct<family: string, given: string, literal: string>>)")), name), lambda n: n.isNotNull())


def spoken_names(authors: Column) -> Column:
    """'given family' of every author; the literal of those that have one."""
    name = lambda a: F.coalesce(a["literal"], F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.filter(F.transform(F.coalesce(authors, F.expr("cast(array() as array<struct<family: string, given: string, literal: string>>)")), name), lambda n: n != "")


def citation_string(title: Column, container: Column, volume: Column, page: Column, year: Column) -> Column:
    """'Title. Journal Vol: Pages. Year', with what is missing left out."""
    title, container, volume, page = (F.coalesce(c.cast("string"), F.lit("")) for c in (F.trim(title), container, volume, page))
    parts = (
        F.when(title != "", F.concat(F.regexp_replace(title, r"[. ]+$", ""), F.lit(". "))).otherwise(""),
        F.when(container != "", F.concat(container, F.lit(" "))).otherwise(""),
        volume,
        F.when(page == "", "").when(volume != "", F.concat(F.lit(": "), page)).otherwise(F.concat(F.lit("pp. "), page)),
        F.when((volume != "") | (page != ""), ". ").otherwise(""),
        F.coalesce(year.cast("string"), F.lit("")),
    )
    return F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))
