"""Consensus of a cluster: each field is voted on, record by record, and beliefs are updated in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import csl

CONFIDENCE = 0.8
FIELDS = ["author", "title", "container_title", "volume", "issue", "page_first", "page", "issued_year", "issued_month", "issued_day", "DOI", "type"]


def loose(c: Column) -> Column:
    """What values are compared by: those that look like numbers, as numbers."""
    number = c.try_cast("double")
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$") & number.isNotNull(), number.cast("string")).otherwise(c)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def rounded(belief: Column) -> Column:
    """To two places, halves up. Ten places are looked at: what the sums of floats leave behind those decides no half."""
    return F.round(belief.cast("decimal(18,10)"), 2).cast("double")


def tally(votes: Column, confidence: float = CONFIDENCE) -> Column:
    """struct<values, beliefs>: the distinct values of an array in order of first use, by loose equality, and the belief in each after all votes.

    Nulls are no votes. Votes become places among the values once; beliefs are then folded over places: multiplied,
    normalised and rounded to two places at every vote.
    """
    given = F.filter(votes, lambda v: v.isNotNull())

    def fold(x: Column) -> Column:
        n = F.size(x["names"])
        index = F.sequence(F.lit(1), n)
        other = F.when(n > 1, (1 - confidence) / (n - 1)).otherwise(F.lit(0.0))

        def update(acc: Column, at: Column) -> Column:
            share = lambda i: F.when(i == at, F.lit(confidence)).otherwise(other)
            product = F.when(F.size(acc) == 0, F.transform(index, share)).otherwise(F.zip_with(acc, index, lambda p, i: p * share(i)))
            normed = lambda z: let(F.aggregate(z, F.lit(0.0), lambda t, p: t + p), lambda total: F.transform(z, lambda p: rounded(p / total)))
            return let(product, lambda z: F.when(F.size(acc) == 0, z).otherwise(normed(z)))

        values = F.transform(x["names"], lambda k: F.element_at(x["given"], F.array_position(x["keys"], k).cast("int")))
        places = F.transform(x["keys"], lambda k: F.array_position(x["names"], k).cast("int"))
        beliefs = F.when(n > 0, F.aggregate(places, F.expr("cast(array() as array<double>)"), update)).otherwise(F.expr("cast(array() as array<double>)"))
        return F.struct(values.alias("values"), beliefs.alias("beliefs"))

    keyed = let(given, lambda g: F.struct(g.alias("given"), F.transform(g, loose).alias("keys")))
    named = let(keyed, lambda x: F.struct(x["given"].alias("given"), x["keys"].alias("keys"), F.array_distinct(x["keys"]).alias("names")))
    return let(named, fold)


def unique(votes: Column) -> Column:
    """The distinct values of an array in order of first use, by loose equality; nulls are no votes."""
    return tally(votes)["values"]


def belief(votes: Column, confidence: float = CONFIDENCE) -> Column:
    """The belief in each of unique(votes) after all votes."""
    return tally(votes, confidence)["beliefs"]


def winner(values: Column, beliefs: Column) -> Column:
    """The first of the values with the greatest belief."""
    return F.try_element_at(values, F.array_position(beliefs, F.array_max(beliefs)).cast("int"))


def vote(rows: DataFrame, key: str, value: str, order: list[str], confidence: float = CONFIDENCE) -> DataFrame:
    """key, winner, belief (its own, to two places), n_values, n_votes. rows are taken in order, which must be total."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_vote")))).alias("_rows"))
    votes = lists.select(key, F.transform("_rows", lambda r: r["_vote"]).alias("votes"))
    found = votes.withColumn("_told", tally(F.col("votes"), confidence)).select(key, "votes", "_told.*")
    return found.select(key, winner(F.col("values"), F.col("beliefs")).alias("winner"), F.array_max("beliefs").alias("belief"), F.size("values").alias("n_values"), F.size(F.filter("votes", lambda v: v.isNotNull())).alias("n_votes"))


def prepared(works: DataFrame) -> DataFrame:
    """Fields as votes: authors as one string, dates in their parts, DOI lower-cased."""
    flip = r"^(.*),\s+(.*)$"
    turned = F.transform(csl.spoken_names(F.col("author")), lambda a: F.when(a.rlike(flip), F.regexp_replace(a, flip, "$2 $1")).otherwise(a))
    joined = F.array_join(turned, ";")
    return works.select(
        "_id",
        "cluster",
        F.when(joined != "", joined).alias("author"),
        "title",
        "container_title",
        "volume",
        "issue",
        "page_first",
        "page",
        *(F.col("issued")[p].cast("string").alias(f"issued_{p}") for p in ("year", "month", "day")),
        F.lower("DOI").alias("DOI"),
        "type",
        F.transform(F.coalesce("is_referenced_by", F.expr("cast(array() as array<struct<DOI: string, URL: string, source: string>>)")), lambda c: c["DOI"]).alias("_citers"),
    )


def split_authors(joined: Column) -> Column:
    """family and given of each of the joined authors: around the comma, else before the last word."""
    flip = r"^(.*),\s+(.*)$"

    def one(name: Column) -> Column:
        parts = F.split(name, " ", -1)
        n = F.size(parts)
        plain = F.struct(F.element_at(parts, -1).alias("family"), F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), " ")).alias("given"))
        return F.when(name.rlike(flip), F.struct(F.regexp_extract(name, flip, 1).alias("family"), F.regexp_extract(name, flip, 2).alias("given"))).otherwise(plain)

    return F.transform(F.split(joined, ";", -1), one)


def consensus(works: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """One record for each cluster: the winners of its fields, members, citers (repeats kept), beliefs, and a page warning.

    Records vote in the order of their ids. A group is one cluster.
    """
    rows = prepared(works)
    lists = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_id", *FIELDS, "_citers"))).alias("rows"))
    votes = lists.select("cluster", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), _field("rows", f).alias("votes")) for f in FIELDS))))
    told = votes.withColumn("_told", tally(F.col("votes"), confidence)).select("cluster", "field", "_told.*")
    told = told.select("cluster", "field", winner(F.col("values"), F.col("beliefs")).alias("won"), F.size("values").alias("n"), "beliefs")
    # one row for each field, back to one for each cluster
    won = {f: F.max(F.when(F.col("field") == f, F.col("won"))).alias(f) for f in FIELDS}
    warning = F.coalesce(F.max(F.when(F.col("field") == "page", F.col("n") > 1)), F.lit(False))
    by = told.groupBy("cluster").agg(*won.values(), warning.alias("page_warning"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "beliefs")))).alias("confidence"))
    fixed = lists.select("cluster", F.transform("rows", lambda r: r["_id"]).alias("members"), F.flatten(F.transform("rows", lambda r: r["_citers"])).alias("is_referenced_by"))
    return by.join(fixed, "cluster").select(
        "cluster",
        "members",
        F.when(F.col("author").isNotNull(), split_authors(F.col("author"))).alias("author"),
        *FIELDS[1:7],
        F.struct(*(F.col(f"issued_{p}").try_cast("bigint").alias(p) for p in ("year", "month", "day"))).alias("issued"),
        "DOI",
        "type",
        "is_referenced_by",
        "page_warning",
        "confidence",
    )


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])
