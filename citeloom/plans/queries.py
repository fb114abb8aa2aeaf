"""Registered queries: the engine's operators over relations derived from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import Catalog
from citeloom.functions import csl, similarity, text
from citeloom.operators import browse, consensus, containers, coverage, export, linkage, search, views
from citeloom.operators.tables import shared_dir, written
from citeloom.plans.relations import coverage_l, names_p, names_t, queue_e, table, votes_l, works_d, works_o
from citeloom.sources import csl as csl_source
from citeloom.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def over(relation: Callable, f: Callable[[DataFrame], DataFrame], name: str) -> None:
    """A query that applies an operator to one relation."""
    QUERIES[name] = lambda spark, sf_dir: f(relation(spark, sf_dir))


over(works_d, views.stats, "stats_works_clusters")
over(works_d, views.doi, "doi_index")
over(works_d, lambda w: linkage.block_pairs(linkage.doi_block(w)), "doi_block_pairs")
over(works_o, views.work_hash, "hash_index")
over(works_o, lambda w: linkage.block_pairs(linkage.hash_block(w)), "hash_block_pairs")
over(works_o, views.container_letters, "letter_counts")
over(works_o, views.container_names, "letter_name_counts")
over(works_o, views.container_year_page, "container_year_page")
over(works_o, views.clusters, "cluster_index")
over(works_o, views.family_letters, "family_letters")
over(works_o, views.family_names, "family_names")
over(works_o, views.family_years, "family_year")
over(works_o, views.years, "years")
over(works_o, lambda w: views.values(w, "title"), "title_counts")
over(works_o, lambda w: views.values(w, "container_title"), "container_counts")
over(works_o, views.family_given, "family_given")
over(works_o, lambda w: views.odd_containers(w.withColumn("container_title", F.when(F.col("issue") == "F", F.col("page")).otherwise(F.col("container_title")))), "nonletter_containers")
over(works_d, lambda w: views.odd_containers(w.withColumn("container_title", F.col("title"))), "nonletter_leads")
over(works_d, lambda w: views.odd_containers(w.withColumn("container_title", F.explode(F.split("title", " ")))).distinct(), "nonletter_words")
over(works_o, views.sources, "source_counts")
over(works_o, lambda w: browse.volumes(w), "volumes_in_year")
over(works_o, lambda w: browse.envelope(views.live(w), F.col("issued.year")), "works_envelope")
over(works_o, lambda w: browse.by_volume(w, 1996, 3), "volume_envelope")
over(works_o, lambda w: browse.by_family(w, "Customer#000000007"), "family_envelope")
over(works_d, lambda w: browse.members(w).select("cluster", F.array_join("members", ",").alias("members")), "cluster_members")


@query
def author_letter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of the author list at once."""
    names = views.family_names(works_o(spark, sf_dir))
    return names.rollup("letter", "family").agg(F.sum("n").alias("n")).filter("letter IS NOT NULL")


@query
def tier_ladder_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 1 by text digest; tier 2 by length and the length of the source's name."""
    w = works_d(spark, sf_dir)
    w = w.withColumns({"issued": F.struct(F.lit(2000).cast("bigint").alias("year"), F.lit(None).cast("bigint").alias("month"), F.lit(None).cast("bigint").alias("day")), "volume": F.regexp_replace("container_title", r"\D", "")})
    return linkage.ladder_pairs(w)


@query
def work_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works_d(spark, sf_dir)
    return linkage.cluster(w, linkage.block_stars(linkage.doi_block(w)))


@query
def asserted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by hash pairs; neighbouring customers' first orders asserted the same, pairs of one status asserted different."""
    w = works_o(spark, sf_dir)
    pairs = linkage.block_pairs(linkage.hash_block(w))
    status = w.select(F.col("_id"), "issue")
    never = pairs.join(status.select(F.col("_id").alias("a"), F.col("issue").alias("x")), "a").join(status.select(F.col("_id").alias("b"), F.col("issue").alias("y")), "b").filter("x = y").select("a", "b")
    first = w.groupBy("page_first").agg(F.min("_id").alias("i")).withColumn("c", F.col("page_first").cast("bigint"))
    must = first.select(F.col("i").alias("a"), "c").join(first.select(F.col("i").alias("b"), (F.col("c") - 1).alias("c")), "c").filter("c % 10 = 0").select("a", "b")
    return linkage.cluster(w, pairs, must, never)


def _compared(spark: SparkSession, sf_dir: str, date_precision: int) -> DataFrame:
    w = works_o(spark, sf_dir)
    return linkage.compare(linkage.block_pairs(linkage.hash_block(w)), w, date_precision)


@query
def feature_vectors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, 3).select("a", "b", F.concat_ws(",", F.transform("features", lambda x: x.cast("string"))).alias("features"))


@query
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, 0).select("a", "b", "score", "diff", "match")


@query
def levenshtein_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of the parts' names that share a type."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    x, y = F.col("a"), F.col("b")
    first = lambda c: F.split(c, " ")[0]
    pairs = p.select(F.col("p_name").alias("a"), first("p_name").alias("k")).join(p.select(F.col("p_name").alias("b"), first("p_name").alias("k")), "k").filter("a < b")
    one, two = text.normalise_title(x), text.normalise_title(y)
    bits = F.array_join(F.transform(linkage.edit_distance(one, two), lambda b: b.cast("string")), ",")
    return pairs.select("a", "b", F.levenshtein(one, two).alias("distance"), F.round(similarity.levenshtein_similarity(one, two), 4).alias("similarity"), bits.alias("bits"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one source, language and length."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    one, two = d.select("source", "lang", "n_chars", F.col("doc_id").alias("a"), F.col("text").alias("ta")), d.select("source", "lang", "n_chars", F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return one.join(two, ["source", "lang", "n_chars"]).filter("a < b").select("a", "b", "ta", "tb")


@query
def alignment_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignment of whole texts of documents alike in source, language and length."""
    n = _neighbours(spark, sf_dir)
    return n.select("a", "b", F.round(similarity.alignment(text.normalise_title(F.col("ta")), text.normalise_title(F.col("tb"))), 6).alias("score"))


@query
def name_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignment of names that share their first few prefixes."""
    n = containers.keyed(names_t(spark, sf_dir)).filter("key_c <> ''").select("key_c", "normalized").distinct()
    pairs = n.withColumnRenamed("normalized", "a").join(n.withColumnRenamed("normalized", "b"), "key_c").filter("a < b")
    return pairs.select("a", "b", F.round(similarity.alignment(F.col("a"), F.col("b")), 6).alias("score"))


@query
def comparison_log_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    log = linkage.ring(rows, "conv_id", ["turn"])
    return log.select("conv_id", F.array_join(F.transform("comparisons", lambda c: F.concat_ws(":", c["turn"].cast("string"), c["role"])), ",").alias("log"))


over(queue_e, lambda q: linkage.stalest(q, 25).select("_id", "visited"), "queue_head_global")
over(queue_e, lambda q: linkage.stalest(q, 5, "scope"), "queue_head_by_scope")


@query
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works_o(spark, sf_dir).withColumn("visited", F.when(F.col("issued.day") > 3, F.concat_ws("-", "issued.year", F.lpad(F.col("issued.month").cast("string"), 2, "0"), F.lpad(F.col("issued.day").cast("string"), 2, "0"))))
    return linkage.queue_status(w, 5)


@query
def drain_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works a pass would visit that began at a date, after those of one customer were stamped."""
    w = works_o(spark, sf_dir)
    w = linkage.mark_visited(w, w.filter("page_first = '7'"), "2030-01-01")
    return linkage.drain(w, "2025-01-01")


@query
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cited works, orders as citing ones."""
    return _cited(spark, sf_dir, views.referenced_by)


@query
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir, browse.citation_counts)


def _cited(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    citers = F.struct(F.col("l_orderkey").cast("string").alias("DOI"), F.lit(None).cast("string").alias("URL"), F.lit("l").alias("source"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list(citers).alias("is_referenced_by"))
    return f(by.select(F.col("l_partkey").cast("string").alias("cluster"), "is_referenced_by", F.lit("work").alias("kind"), F.lit(None).cast("string").alias("deleted")))


@query
def consensus_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.vote(votes_l(spark, sf_dir), "l_partkey", "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"]).select("l_partkey", "winner", "n_values", "n_votes")


@query
def consensus_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused record of every cluster of works from orders."""
    c = consensus.consensus(works_o(spark, sf_dir))
    family = F.array_join(F.transform("author", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")
    return c.select("cluster", F.size("members").alias("n"), family.alias("author"), "title", "container_title", "volume", "issue", "page", F.col("issued.year").alias("year"), F.col("issued.day").alias("day"), "type", "page_warning")


@query
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.keyed(names_p(spark, sf_dir)).drop("issn")


@query
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names that carry series markers: document sources with markers put behind."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("Annals of the "), F.col("source"), F.lit(" Museum, (ser. "), (F.col("doc_id") % 12).cast("string"), F.lit(") n. s."))
    return containers.keyed(d.select(F.col("doc_id").alias("id"), raw.alias("raw"))).select("id", "tokens", "series", "key_a", "key_c", "key_d")


@query
def tokens_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of documents, and their words without stop words."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalise_title(F.col("text")).alias("title"))
    return d.select("doc_id", "title", F.array_join(text.told_words(F.col("title")), " ").alias("tokens"))


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = names_p(spark, sf_dir).select("raw").distinct()
    return names.select("raw", text.slug(F.col("raw")).alias("slug"), text.slug(F.repeat("raw", 5)).alias("long_slug"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.runs(containers.keyed(names_t(spark, sf_dir)))


def _told(clusters: DataFrame) -> DataFrame:
    """Clusters by their least member."""
    return clusters.groupBy("cluster_id").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("normalized").alias("first"), F.max("normalized").alias("last")).drop("cluster_id")


def _by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names clustered by one key."""
    names = written(containers.keyed(names_p(spark, sf_dir)), "names")
    return names.join(names.groupBy("key_a").agg(F.min("id").alias("cluster_id")), "key_a")


@query
def runs_and_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_runs(spark, sf_dir))


@query
def runs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 names in order, each with its likeness to the one before."""
    return containers.runs_report(containers.keyed(names_t(spark, sf_dir)).dropDuplicates(["normalized"]), limit=150).select("normalized", F.round("lcs", 4).alias("lcs"), F.round("prefix", 4).alias("prefix"))


@query
def block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By likeness of representatives alone."""
    return _told(containers.block_union(_runs(spark, sf_dir), issn=False))


@query
def block_union_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likewise, with blocks of any size."""
    return _told(containers.block_union(_runs(spark, sf_dir), issn=False, cap=None))


@query
def union_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.cluster_stats(containers.block_union(_runs(spark, sf_dir)))


@query
def issn_must_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by key, merged where they share an ISSN."""
    names = _by_key(spark, sf_dir)
    return containers.block_union(names, keys=("key_b",), threshold=2.0).select("id", "cluster_id")


over(_by_key, containers.cluster_stats, "cluster_stats")
over(_by_key, containers.largest, "largest_clusters")
over(_by_key, containers.issn_purity, "issn_purity")
over(_by_key, lambda n: containers.journal_quality(n, n.select("id", F.col("issn").alias("journal"))), "over_merge")
over(_by_key, containers.journals, "journal_groups")
over(_by_key, lambda n: containers.spellings(n).drop("key_a"), "cluster_spellings")


@query
def container_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = containers.container_docs(_by_key(spark, sf_dir), "20240101")
    return docs.select("cluster_id", "_id", "name", F.array_join("variants", "|").alias("variants"), F.array_join("ISSN", "|").alias("ISSN"), "junk")


def _curated(names: DataFrame) -> DataFrame:
    """Spellings that curated containers own: by nature few of all."""
    return names.filter("id % 97 = 0").select(F.col("raw").alias("variant"))


@query
def curation_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _by_key(spark, sf_dir)
    return containers.absorbed(containers.spellings(names), _curated(names))


@query
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.review_sheet(_runs(spark, sf_dir).filter("key_a <> ''"), 2).drop("cluster_id")


@query
def variant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling's container."""
    names = _by_key(spark, sf_dir)
    return containers.resolve(names.select(F.col("raw").alias("variant")).distinct(), containers.container_docs(names, "20240101"))


@query
def container_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of the journals spelled in two ways."""
    w = works_o(spark, sf_dir)
    return browse.by_container(w, w.select(F.col("container_title").alias("variant")).filter("variant IN ('BUILDING', 'MACHINERY')"))


@query
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All works whose titles have both words."""
    return search.search(works_d(spark, sf_dir), "the of", None).select("_id")


@query
def title_search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(works_d(spark, sf_dir), "the of", 20).select("_id", F.round("score", 6).alias("score"))


@query
def search_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits, collapsed."""
    w = works_d(spark, sf_dir)
    return search.collapse(search.search(w, "the of", None), w).select("cluster", "_id", "cluster_size")


over(works_o, lambda w: w.select("_id", export.ris().alias("record")), "export_ris")
over(works_o, lambda w: w.select("_id", export.ris_view().alias("record")), "export_ris_view")
over(works_o, lambda w: w.select("_id", export.ris_library().alias("record")), "export_ris_library")
over(works_o, lambda w: w.select("_id", export.bibtex().alias("record")), "export_bibtex")
over(works_o, lambda w: w.select("_id", export.openurl().alias("record")), "export_openurl")
over(works_o, lambda w: w.select("_id", export.tsv().alias("record")), "export_tsv")
over(works_o, lambda w: w.select("_id", csl.citation_string(F.col("title"), F.col("container_title"), F.col("volume"), F.col("page"), F.col("issued.year")).alias("citation")), "citation_strings")


over(works_o, lambda w: browse.ranked(w, browse.export_order(w)), "export_order")
over(works_o, lambda w: browse.ranked(w, browse.display_order()), "display_sort")
over(works_o, lambda w: browse.page_coverage(w).select("_id", "first", "last", "lo", "hi", "articles", F.floor(F.col("left")).alias("left"), F.floor(F.col("width")).alias("width")), "page_coverage")
over(works_o, browse.page_gaps, "page_gaps")
over(works_o, lambda w: w.select("_id", F.array_join(csl.page_range(F.regexp_replace("page", r"-\d*(\d\d)$", "-$1")), "-").alias("pages")), "abbreviated_pages")


@query
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and customer keys as roman numerals, read back."""
    t = F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 40), lambda i: F.lit("X"))
    s = F.concat(F.when(F.col("c_custkey") % 2 == 0, "C").otherwise("XL"), F.array_join(F.slice(t, 1, 3), ""), F.when(F.col("c_custkey") % 3 == 0, "IX").otherwise("VI"))
    return table(spark, sf_dir, "customer").select("c_custkey", csl.roman(s).alias("value"), csl.volume_number(F.concat(F.lit("Fasc. "), "c_custkey")).alias("volume"))


over(coverage_l, coverage.summary, "coverage_summary")
over(coverage_l, coverage.lowest, "coverage_lowest")
over(coverage_l, coverage.gaps, "coverage_gaps")


@query
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("cluster_id"))
    return coverage.status(docs, coverage_l(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query
def coverage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of works from orders, asked of a matcher that knows every third one by its length."""
    asked = coverage.citations(works_o(spark, sf_dir))
    got = coverage.reconcile(asked, lambda qs: [(str(len(q)), q[:10], 1.0) if len(q) % 3 == 0 else None for q in qs], "all", "2024-01-01")
    return got.groupBy("matched").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("chars"))


@query
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_index(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.length("title").alias("n"), text.clean_title(F.col("title")).alias("title"))


@query
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_index(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.size("links").alias("n"))


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of documents without tags and entities, dots and spaces tidied."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.clean_title(F.col("text"))).alias("digest"))


@query
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.bag_of_words(F.concat_ws(" ", "p_type", "p_name")).alias("bag"))


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user, later ones first among equals."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("modified"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("e"))
    e = e.withColumn("modified", F.concat_ws("#", "modified", "e")).drop("e")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    return csl_source.upsert(old, new).select("_id", "event_id")


@query
def id_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of records of every kind, made of documents."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    raw = F.concat(
        F.lit("{"), F.when(k == 0, F.concat(F.lit('"_id":"w'), "doc_id", F.lit('"'))).when(k == 1, F.concat(F.lit('"id":"'), "doc_id", F.lit('"'))).when(k == 2, F.concat(F.lit('"id":"pub:'), "doc_id", F.lit('"'))).otherwise(F.concat(F.lit('"id":"x'), "doc_id", F.lit('"'))), F.lit("}")
    )
    docs = csl_source.parse_lines(d.select("doc_id", raw.alias("value")))
    return docs.select(F.col("text"), csl_source.record_id().alias("_id"))


@query
def prefix_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as prefixes, regions as agencies."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("/", F.col("s_nationkey").cast("string"), "s_name").alias("doi"))
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("prefix"), F.col("n_name").alias("agency"))
    return csl_source.agencies(s, n).select("s_suppkey", "prefix", "agency")


@query
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.container_year_page(works_o(spark, sf_dir))
    return csl_source.key_range(rows, "container", "BUILDING", 1996, 1997).select("_id", "year", "spage")


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/citeloom/{tag}-{uuid.uuid4().hex}"


def _filed(lines: DataFrame, tag: str) -> str:
    """The folder of text files that hold the lines."""
    path = _folder(lines.sparkSession, tag)
    lines.write.text(path)
    return path


def _loaded(docs: DataFrame) -> DataFrame:
    w = csl_source.works(docs, "orders", "csl", "2024-01-01")
    return w.select("_id", "type", "title", "container_title", "volume", "issue", "page", F.col("author")[0]["family"].alias("family"), F.col("issued.year").alias("year"), "source", "created", "cluster")


@query
def load_csl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works from orders, written as lines of JSON and read back; their dates are no CSL dates."""
    lines = works_o(spark, sf_dir).select(export.csl_json().alias("value"))
    return _loaded(csl_source.read_lines(spark, _filed(lines, "lines")))


@query
def load_csl_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likewise, as JSON arrays."""
    path = _folder(spark, "arrays")
    export.write_arrays(works_o(spark, sf_dir).select(export.csl_json().alias("record")), path)
    return _loaded(csl_source.read_array(spark, path))


@query
def load_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ISSNs, written as TSV with blank lines and read back."""
    names = names_p(spark, sf_dir).select(F.explode(F.array(F.concat_ws("\t", "raw", F.when(F.col("id") % 2 == 0, F.col("issn")).otherwise(F.lit(""))), F.lit(" "))).alias("value"))
    return markup.read_names(spark, _filed(names, "names")).groupBy("raw", "issn").agg(F.count("*").alias("n"))


@query
def text_line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of orders, one on each line of text files."""
    w = works_o(spark, sf_dir)
    lines = w.select(csl.citation_string(F.col("title"), F.col("container_title"), F.col("volume"), F.col("page"), F.col("issued.year")).alias("value"))
    refs = markup.text_references(spark, _filed(lines, "references"), "10.1/x")
    return refs.select("unstructured", F.col("is_referenced_by")[0]["DOI"].alias("citing")).groupBy("unstructured", "citing").agg(F.count("*").alias("n"))


@query
def jats_article_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each customer, whose references are the customer's orders."""
    w = works_o(spark, sf_dir)
    pages = F.split("page", "-")
    tag = lambda name, c, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), c, F.lit(f"</{name}>"))
    name = tag("name", F.concat(tag("surname", F.col("author")[0]["family"]), tag("given-names", F.col("author")[0]["given"])))
    fields = [tag("person-group", name), tag("article-title", F.col("title")), tag("source", F.col("container_title")), tag("volume", F.col("volume")), tag("issue", F.col("issue")), tag("year", F.concat(F.col("issued.year").cast("string"), F.lit("a"))), tag("fpage", pages[0]), tag("lpage", pages[1])]
    ref = F.concat(F.lit('<ref id="'), "_id", F.lit('">'), tag("element-citation", F.concat(*fields)), F.lit("</ref>"))
    articles = w.groupBy("page_first").agg(F.array_join(F.array_sort(F.collect_list(ref)), "").alias("refs"))
    front = F.concat(F.lit('<front><article-meta><article-id pub-id-type="doi">10.9/'), "page_first", F.lit("</article-id></article-meta></front>"))
    xml = articles.select(F.concat(F.lit("<!DOCTYPE article><article>"), front, F.lit("<back><ref-list>"), "refs", F.lit("</ref-list></back></article>")).alias("value"))
    refs = markup.parse_jats(xml)
    return refs.select("_id", "type", F.col("author")[0]["family"].alias("family"), F.col("author")[0]["given"].alias("given"), "title", "container_title", "volume", "issue", F.col("year").cast("bigint").alias("year"), "page", F.col("is_referenced_by")[0]["DOI"].alias("citing"))


@query
def html_meta_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, with the customer's orders as citation_reference tags."""
    w = works_o(spark, sf_dir)
    meta = F.concat(F.lit('<meta name="citation_reference" content="'), "title", F.lit(" &amp; "), "_id", F.lit('">'))
    by = w.groupBy("page_first").agg(F.array_join(F.array_sort(F.collect_list(meta)), "").alias("metas"))
    pages = by.select(F.concat(F.lit('<html><head><meta name="citation_doi" content="10.9/X'), "page_first", F.lit('">'), "metas", F.lit("</head></html>")).alias("html"))
    return markup.html_references(pages)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container documents; those of every third cluster are curated."""
    docs = containers.container_docs(_by_key(spark, sf_dir), "20240101")
    return docs.withColumn("curated", F.col("cluster_id") % 3 == 0)


over(_docs, views.container_list, "container_list")
over(_docs, views.manage, "container_manage")
over(_docs, lambda d: views.variants(d), "container_variants")
over(_by_key, lambda n: containers.split_journals(n, n.select("id", F.col("issn").alias("journal"))), "split_journals")
over(_by_key, lambda n: containers.merged_journals(n, n.select("id", F.col("issn").alias("journal"))), "merged_journals")
over(works_o, lambda w: views.short_titles(w.withColumn("container_title_short", F.substring("container_title", 1, 4))), "short_titles")
over(works_o, lambda w: browse.simplify(w).select("_id", "title", "container_title", "volume", "issue", "page", F.col("issued.year").alias("year")), "simplified")
over(works_o, lambda w: w.select("_id", csl.clean_doi(F.concat(F.when(F.col("issue") == "F", "https://doi.org/").when(F.col("issue") == "O", "HTTP://dx.doi.org/").otherwise(""), F.lit("10.1/ABC."), F.col("page"))).alias("doi")), "clean_dois")
over(works_o, lambda w: linkage.graph_text(w.select("_id", "cluster")), "cluster_graph")
over(works_o, lambda w: linkage.training_rows(linkage.compare(linkage.block_pairs(linkage.hash_block(w)), w, 3)).groupBy("row").agg(F.count("*").alias("n")), "training_rows")
over(works_d, lambda w: w.select("_id", F.md5(text.unaccent(F.col("title"))).alias("digest")), "unaccented")
over(names_t, lambda n: n.select("id", text.folded_letter(F.col("raw")).alias("letter"), text.shorten(F.col("raw"), 30).alias("short"), text.one_line(F.col("raw")).alias("line")), "name_letters")
over(names_t, lambda n: containers.keyed(n).select("id", text.is_clean(F.col("raw"), F.col("key_a")).alias("clean")), "clean_names")


def route(relation: Callable, f: Callable[[Catalog], DataFrame], name: str) -> None:
    """A query that asks a catalogue of one relation."""
    QUERIES[f"route_{name}"] = lambda spark, sf_dir: f(Catalog(relation(spark, sf_dir)))


route(works_o, lambda c: c.years(), "years")
route(works_o, lambda c: c.author_letters(), "author_letters")
route(works_o, lambda c: c.authors("C"), "authors")
route(works_o, lambda c: c.volumes(1996), "volumes")
route(works_o, lambda c: c.records("urn:o:000000000001|urn:o:000000000002,urn:o:000000000003").select("_id", "title", "page"), "records")
route(works_o, lambda c: c.works_by_title("BUILDING").select("outer", "cluster", "_id", "cluster_size"), "works_by_title")
route(works_o, lambda c: c.export(c.works_by_volume(1996, 3), "ris"), "export")
route(works_d, lambda c: c.search("the of", None).select("cluster", "_id", "cluster_size"), "search")


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: blocked by digest, compared, clustered, counted."""
    w = works_d(spark, sf_dir).drop("cluster")
    pairs = linkage.block_pairs(linkage.doi_block(w))
    found = linkage.compare(pairs, w)
    clusters = linkage.cluster(w, found.filter("match"))
    return views.stats(w.join(clusters, "_id"))
