"""Record linkage: blocks, pairs, feature vectors, decisions, work clusters, the comparison log, the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import similarity, text
from citeloom.operators import views
from citeloom.operators.components import connected_components

THRESHOLD = 0.8
LOG = 5
ALGORITHM = "heuristic-v1"


def doi_block(works: DataFrame) -> DataFrame:
    return views.live(works).filter(F.col("DOI").isNotNull()).select("_id", F.lower("DOI").alias("block"))


def hash_block(works: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "year", "volume", "page_first")
    return views.work_hash(works).filter("year IS NOT NULL").select("_id", key.alias("block"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """a < b for all records of a block. A block's rows meet in a self-join by its key, which may be split where it is large."""
    one, two = blocks.select("block", F.col("_id").alias("a")), blocks.select("block", F.col("_id").alias("b"))
    return one.join(two, "block").filter("a < b").select("a", "b").distinct()


def ladder_pairs(works: DataFrame) -> DataFrame:
    """Pairs of one pass of the worker, and the tier they come from.

    All pairs of DOI blocks with several records; of hash blocks, those of blocks that hold a
    record whose DOI block has no other.
    """
    dois, hashes = doi_block(works), hash_block(works)
    busy = dois.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").join(dois, "block").select("_id")
    idle = hashes.join(busy, "_id", "left_anti").select("block").distinct()
    first = block_pairs(dois).withColumn("tier", F.lit(1))
    second = block_pairs(hashes.join(idle, "block", "left_semi")).withColumn("tier", F.lit(2))
    return first.unionByName(second).groupBy("a", "b").agg(F.min("tier").alias("tier"))


def _bits(same: Column, known: Column) -> Column:
    """[same, diff]; neither where a side is missing."""
    return F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit(0), F.lit(0))).otherwise(F.array(same.cast("int"), (~same).cast("int")))


def block_stars(blocks: DataFrame) -> DataFrame:
    """a, b: every record of a block with the block's least one. Enough for clusters where a block's records all match; no group is gathered."""
    hub = blocks.groupBy("block").agg(F.min("_id").alias("a"))
    return blocks.join(hub, "block").select("a", F.col("_id").alias("b")).filter("a <> b").distinct()


def exact(x: Column, y: Column) -> Column:
    """Equality of normalised values; two that both normalise to nothing are the same."""
    return _bits(x == y, x.isNotNull() & y.isNotNull())


def aligned(x: Column, y: Column) -> Column:
    """Local alignment of normalised values above the threshold; an empty side is missing, equal sides need no alignment."""
    score = F.when(x == y, F.lit(1.0)).otherwise(similarity.alignment(x, y))
    return _bits(score > THRESHOLD, (F.length(x) > 0) & (F.length(y) > 0))


def aligned_exactly(x: Column, y: Column) -> Column:
    """For inputs whose titles are equal or unlike: equality in place of alignment."""
    return _bits(x == y, (F.length(x) > 0) & (F.length(y) > 0))


def edit_distance(x: Column, y: Column) -> Column:
    """Levenshtein similarity of normalised values, cut to a bounded length, above 0.9."""
    return _bits(similarity.levenshtein_similarity(text.shorten(x), text.shorten(y)) > 0.9, x.isNotNull() & y.isNotNull() & (F.greatest(F.length(x), F.length(y)) > 0))


def comparable(works: DataFrame) -> DataFrame:
    """_id and what records are compared by, normalised once for each record (not for each pair)."""
    norm = {c: text.normalise_title(F.col(c)).alias(c) for c in ("title", "container_title", "volume", "issue", "page", "DOI")}
    family = F.get("author", F.lit(0))["family"].alias("family")
    return works.select("_id", family, *norm.values(), *(F.col("issued")[p].alias(p) for p in ("year", "month", "day")))


def feature_vector(a: str = "l", b: str = "r", date_precision: int = 0, subsequence=aligned) -> Column:
    """Author, title, container, volume, issue, page, the first parts of the date, DOI; [same, diff] each.

    a, b: names of two struct columns of comparable(). date_precision 0 leaves dates out.
    """
    f = lambda n: (F.col(f"{a}.{n}"), F.col(f"{b}.{n}"))
    parts = [exact(*f("family")), *(subsequence(*f(n)) for n in ("title", "container_title")), *(exact(*f(n)) for n in ("volume", "issue", "page"))]
    parts += [exact(*f(n)) for n in ("year", "month", "day")[:date_precision]]
    return F.concat(*parts, exact(*f("DOI")))


def decision(vector: Column) -> tuple[Column, Column, Column]:
    """score (same bits), diff (different bits), and whether it is a match: at least three the same, none different."""
    at = lambda odd: F.aggregate(F.filter(vector, lambda _, i: i % 2 == odd), F.lit(0), lambda n, x: n + x)
    same, diff = at(0), at(1)
    return same, diff, (same >= 3) & (diff == 0)


def compare(pairs: DataFrame, works: DataFrame, date_precision: int = 0, subsequence=aligned) -> DataFrame:
    """a, b, features, score, diff, match of every pair."""
    side = comparable(works)
    fields = F.struct(*[c for c in side.columns if c != "_id"])
    both = pairs.join(side.select(F.col("_id").alias("a"), fields.alias("l")), "a").join(side.select(F.col("_id").alias("b"), fields.alias("r")), "b")
    vectors = both.withColumn("features", feature_vector("l", "r", date_precision, subsequence)).drop("l", "r")
    same, diff, match = decision(F.col("features"))
    return vectors.select(*pairs.columns, "features", same.alias("score"), diff.alias("diff"), match.alias("match"))


def cluster(works: DataFrame, matches: DataFrame, must: DataFrame | None = None, never: DataFrame | None = None) -> DataFrame:
    """_id, cluster: the least id that matches reach; a record without one is its own.

    must: pairs that are asserted the same; never: pairs asserted different, whose match is dropped.
    """
    edges = matches.select("a", "b")
    if never is not None:
        both = never.select("a", "b").unionByName(never.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = edges.join(both, ["a", "b"], "left_anti")
    if must is not None:
        edges = edges.unionByName(must.select("a", "b"))
    found = connected_components(edges)
    return works.select("_id").join(found, works["_id"] == found["id"], "left").select("_id", F.coalesce("component", "_id").alias("cluster"))


def comparison_log(old: DataFrame, new: DataFrame, keep: int = LOG) -> DataFrame:
    """id, comparisons: the last few of every record, oldest first; a comparison is on both records' logs.

    old: id, other, score, decision, at (may be empty); new: a, b, score, decision, at.
    """
    both = new.select(F.col("a").alias("id"), F.col("b").alias("other"), "score", "decision", "at").unionByName(new.select(F.col("b").alias("id"), F.col("a").alias("other"), "score", "decision", "at"))
    return ring(old.unionByName(both), "id", ["at", "other"], keep)


def ring(rows: DataFrame, key: str, order: list[str], keep: int = LOG) -> DataFrame:
    """The last ``keep`` rows of every key, as an array in order."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    rest = [c for c in rows.columns if c not in (key, *order)]
    last = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep)
    return last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("comparisons"))


def stalest(queue: DataFrame, n: int, scope: str | None = None) -> DataFrame:
    """The n records to visit next; with a scope column, of each scope."""
    if scope is None:
        return queue.orderBy(F.asc_nulls_first("visited"), "_id").limit(n)
    w = Window.partitionBy(scope).orderBy(F.asc_nulls_first("visited"), "_id")
    return queue.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def stalest_of_cluster(works: DataFrame, variants: DataFrame, n: int = 1) -> DataFrame:
    """The next records of each container cluster, over all its spellings. variants: variant, _id of the container."""
    spelled = variants.select(F.col("variant").alias("container_title"), F.col("_id").alias("container"))
    return stalest(views.live(works).join(spelled, "container_title").select("container", "_id", "visited"), n, "container")


def mark_visited(works: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Stamp the visit on the records with these ids (_id)."""
    hit = works.join(ids.select("_id").distinct().withColumn("_hit", F.lit(True)), "_id", "left")
    return hit.withColumn("visited", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("visited"))).select(*works.columns)


def drain(works: DataFrame, started: str) -> DataFrame:
    """All records of a scope not visited since the pass began."""
    return views.live(works).filter(F.col("visited").isNull() | (F.col("visited") < started)).select("_id")


def queue_status(works: DataFrame, n: int = 5) -> DataFrame:
    """The head of the queue, whether each is its own cluster, and the queue's length."""
    head = stalest(views.live(works).select("_id", "visited", "cluster"), n)
    total = views.live(works).count()
    return head.select("_id", "visited", (F.col("_id") == F.col("cluster")).alias("own"), F.lit(total).cast("long").alias("total"))


def training_rows(log: DataFrame) -> DataFrame:
    """A tab-separated vector and label for each comparison. log: features, match."""
    return log.select(F.concat_ws("\t", F.transform("features", lambda x: x.cast("string")), F.col("match").cast("int").cast("string")).alias("row"))


def graph_text(clusters: DataFrame, form: str = "dot") -> DataFrame:
    """Lines of a DOT or Mermaid graph: a record points at its cluster. Header and footer stand by 'line'."""
    arrow = {"dot": ("", " -> ", ";"), "mermaid": ("", " --> ", "")}[form]
    edges = clusters.filter(F.col("_id") != F.col("cluster"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = quoted if form == "dot" else (lambda c: c)
    return edges.select(F.concat(F.lit(arrow[0]), name(F.col("_id")), F.lit(arrow[1]), name(F.col("cluster")), F.lit(arrow[2])).alias("line"))
