"""Journal-name clustering: keys, runs and breaks, block union, quality report, container documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import similarity, text
from citeloom.operators.components import connected_components
from citeloom.operators.tables import spread, written

RUN_THRESHOLD, BLOCK_THRESHOLD, BLOCK_CAP = 0.50, 0.85, 600


def keyed(names: DataFrame) -> DataFrame:
    """names: id, raw, issn. Adds normalized, tokens, series and the four keys."""
    return text.with_name_keys(spread(names))


def runs(names: DataFrame, sort: str = "key_a", threshold: float = RUN_THRESHOLD, lcs=similarity.lcs) -> DataFrame:
    """Adds cluster_id: names in order of (sort, normalized, id); a new one starts where neighbours are unlike.

    No window spans all rows. Names are range-partitioned and sorted; each partition compares neighbours and counts its
    breaks, and what a partition's first row needs (the last row before, the breaks so far) is a row for each partition. Names
    with an empty key follow, each alone.
    """
    names = written(names, "names")
    some = names.filter(F.col(sort) != "")
    order = [sort, "normalized", "id"]
    parts = written(some.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "runs")
    w = Window.partitionBy("_part").orderBy("_at")
    inside = parts.withColumn("_before", F.lag("tokens").over(w))
    inside = inside.withColumn("_first", F.col("_before").isNull())
    inside = inside.withColumn("_break", F.when(F.col("_first"), F.lit(0)).otherwise((lcs(F.coalesce("_before", F.lit("")), F.col("tokens")) < threshold).cast("int")))
    inside = written(inside.withColumn("_breaks", F.sum("_break").over(w)).drop("_before", "_break"), "runs")
    ends = inside.groupBy("_part").agg(F.min_by("tokens", "_at").alias("head"), F.max_by("tokens", "_at").alias("tail"), F.max("_breaks").alias("n")).orderBy("_part")
    # a row for each partition
    offsets, at, before = [], 0, None
    for r in ends.collect():
        at += 1 if before is None or similarity.token_lcs(before, r["head"]) < threshold else 0
        offsets.append((r["_part"], at))
        at, before = at + r["n"], r["tail"]
    total = at
    spark = names.sparkSession
    start = spark.createDataFrame(offsets, "_part int, _start long")
    chained = inside.join(F.broadcast(start), "_part").withColumn("cluster_id", F.col("_start") + F.col("_breaks")).select(*names.columns, "cluster_id")
    rest = names.filter(F.coalesce(F.col(sort), F.lit("")) == "").withColumn("cluster_id", F.lit(total) + 1 + F.monotonically_increasing_id())
    return chained.unionByName(rest)


def runs_report(names: DataFrame, sort: str = "key_a", start: str = "", limit: int = 150) -> DataFrame:
    """The first names from a key on, in order, each with its likeness to the one before."""
    head = names.filter((F.col(sort) != "") & (F.col(sort) >= start)).orderBy(sort, "normalized", "id").limit(limit)
    w = Window.orderBy(sort, "normalized", "id")  # of the report's few rows
    before, own = F.coalesce(F.lag("tokens").over(w), F.lit("")), F.col("tokens")
    key = F.coalesce(F.lag(sort).over(w), F.lit(""))
    rows = head.withColumns({"_before": before, "_key": key})
    return rows.withColumns({"lcs": similarity.lcs(F.col("_before"), own), "prefix": similarity.shared_prefix(F.col("_key"), F.col(sort))}).drop("_before", "_key")


def representatives(names: DataFrame) -> DataFrame:
    """Of every cluster, the name with most tokens (the first by id among those)."""
    n = F.when(F.col("tokens") == "", 0).otherwise(F.size(F.split("tokens", " ")))
    rank = F.struct(-n, F.col("id"))
    return names.groupBy("cluster_id").agg(*(F.min_by(c, rank).alias(c) for c in names.columns if c != "cluster_id"))


def block_union(names: DataFrame, keys: tuple[str, ...] = ("key_b", "key_c"), threshold: float = BLOCK_THRESHOLD, cap: int | None = BLOCK_CAP, issn: bool = True, lcs=similarity.lcs) -> DataFrame:
    """Merge clusters whose representatives share a key and are alike, or that share an ISSN; cluster_id is the least of those merged.

    Blocks of more than ``cap`` clusters are left out, as in the method: the key tells nothing there. None compares blocks of any size.
    """
    reps = written(representatives(names.select("id", "cluster_id", "tokens", *keys)).select("cluster_id", "tokens", *keys), "reps")
    edges, n = None, lambda c: F.size(F.split(c, " "))
    # no more tokens can be common than the shorter one has
    may = 2 * F.least(n("ta"), n("tb")) / (n("ta") + n("tb")) >= threshold if lcs is similarity.lcs else F.lit(True)
    for k in keys:
        rows = reps.filter(F.col(k) != "").select(F.col(k).alias("block"), "cluster_id", "tokens")
        fit = rows.groupBy("block").agg(F.count("*").alias("n")).filter((F.col("n") >= 2) & (F.lit(True) if cap is None else F.col("n") <= cap)).select("block")
        rows = rows.join(fit, "block")
        one, two = rows.select("block", F.col("cluster_id").alias("a"), F.col("tokens").alias("ta")), rows.select("block", F.col("cluster_id").alias("b"), F.col("tokens").alias("tb"))
        pairs = one.join(two, "block").filter((F.col("a") < F.col("b")) & may).select("a", "b", "ta", "tb")
        edges = pairs if edges is None else edges.unionByName(pairs)
    edges = edges.distinct().filter(lcs(F.col("ta"), F.col("tb")) >= threshold).select("a", "b")
    if issn:
        star = names.filter(F.col("issn").isNotNull()).select("issn", "cluster_id").distinct()
        hub = star.groupBy("issn").agg(F.min("cluster_id").alias("a"))
        edges = edges.unionByName(star.join(hub, "issn").filter("a <> cluster_id").select("a", F.col("cluster_id").alias("b")))
    return relabel(names, written(connected_components(edges), "union").select(F.col("id").alias("old"), F.col("component").alias("new")))


def relabel(names: DataFrame, moves: DataFrame) -> DataFrame:
    """New cluster ids (old, new) in place of old ones."""
    moved = names.join(moves, names["cluster_id"] == moves["old"], "left")
    return moved.withColumn("cluster_id", F.coalesce("new", "cluster_id")).select(*names.columns)


def cluster_sizes(names: DataFrame) -> DataFrame:
    return names.groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_stats(names: DataFrame) -> DataFrame:
    n = cluster_sizes(names)
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"))


def largest(names: DataFrame, n: int = 12) -> DataFrame:
    """The largest clusters, each with its longest name."""
    rank = F.struct(-F.length("normalized"), F.col("normalized"))
    by = names.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min_by("normalized", rank).alias("name"))
    return by.orderBy(F.desc("n"), "cluster_id").limit(n)


def issn_purity(names: DataFrame) -> DataFrame:
    """Of ISSNs on several rows: how many there are, and how many lie in one cluster."""
    by = names.filter(F.col("issn").isNotNull()).groupBy("issn").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("k")).filter("n > 1")
    return by.agg(F.count("*").alias("issns"), F.count_if(F.col("k") == 1).alias("pure"))


def journals(names: DataFrame) -> DataFrame:
    """id, journal: ISSNs that meet on one normalised name are one journal (named by the least)."""
    by = names.filter(F.col("issn").isNotNull()).select("id", "issn", "normalized")
    hub = by.groupBy("normalized").agg(F.min("issn").alias("a"))
    found = connected_components(by.join(hub, "normalized").select("a", F.col("issn").alias("b")))
    return by.join(found, by["issn"] == found["id"]).select(by["id"], F.col("component").alias("journal"))


def journal_quality(names: DataFrame, labels: DataFrame) -> DataFrame:
    """journals (on several rows), pure (in one cluster), over_merged (clusters of several journals). labels: id, journal."""
    rows = names.join(labels, "id").select("journal", "cluster_id")
    by = rows.groupBy("journal").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("k")).filter("n > 1")
    over = rows.groupBy("cluster_id").agg(F.count_distinct("journal").alias("k")).filter("k > 1").count()
    return by.agg(F.count("*").alias("journals"), F.count_if(F.col("k") == 1).alias("pure"), F.lit(over).cast("long").alias("over_merged"))


def split_journals(names: DataFrame, labels: DataFrame) -> DataFrame:
    """journal, n, clusters of every journal that lies in several clusters. labels: id, journal."""
    by = names.join(labels, "id").groupBy("journal").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters"))
    return by.filter("clusters > 1")


def merged_journals(names: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, n, journals of every cluster that holds several journals. labels: id, journal."""
    by = names.join(labels, "id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("journal").alias("journals"))
    return by.filter("journals > 1")


def spellings(names: DataFrame) -> DataFrame:
    """Distinct names of every cluster: n rows, an ISSN, a key."""
    return names.groupBy("cluster_id", "raw").agg(F.count("*").alias("n"), F.max("issn").alias("issn"), F.max("key_a").alias("key_a"))


def absorbed(spelled: DataFrame, curated: DataFrame) -> DataFrame:
    """cluster_id, claimed, size of clusters of which a curated container (variant) owns a spelling; partly, where claimed < size."""
    own = curated.select(F.col("variant").alias("raw")).distinct().withColumn("own", F.lit(1))
    by = spelled.join(own, "raw", "left").groupBy("cluster_id").agg(F.count("own").alias("claimed"), F.count("*").alias("size"))
    return by.filter("claimed > 0")


def container_docs(names: DataFrame, run: str, curated: DataFrame | None = None, reserved: DataFrame | None = None) -> DataFrame:
    """A document for each cluster that no curated one absorbs. curated: variant; reserved: _id in use.

    Its name is the clean spelling (any, if none is clean) on most rows, then the longest. Names that give the same id are
    numbered by cluster, around reserved ids.
    """
    rows = spellings(names)
    if curated is not None:
        rows = rows.join(absorbed(rows, curated), "cluster_id", "left_anti")
    clean = text.is_clean(F.col("raw"), F.coalesce("key_a", F.lit("")))
    rank = F.struct((~clean).alias("c"), (-F.col("n")).alias("n"), (-F.length("raw")).alias("l"), F.col("raw").alias("r"))
    by = rows.groupBy("cluster_id").agg(
        F.min_by("raw", rank).alias("name"),
        (~F.max(clean)).alias("junk"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "raw"))), lambda s: s["raw"]).alias("variants"),
        F.array_sort(F.collect_set("issn")).alias("ISSN"),
    )
    by = by.withColumn("base", F.concat(F.lit("container:"), text.slug(F.col("name"))))
    w = Window.partitionBy("base").orderBy("cluster_id")
    by = by.withColumn("k", F.row_number().over(w))
    if reserved is not None:
        suffix = F.regexp_extract("_id", r"-(\d+)$", 1).try_cast("int")
        taken = reserved.select(F.col("_id").alias("base"), F.lit(1).alias("t")).unionByName(reserved.select(F.regexp_replace("_id", r"-\d+$", "").alias("base"), suffix.alias("t")).filter("t > 1"))
        by = by.join(taken.groupBy("base").agg(F.array_sort(F.collect_set("t")).alias("taken")), "base", "left")
        by = by.withColumn("k", F.aggregate(F.coalesce("taken", F.expr("cast(array() as array<int>)")), F.col("k"), lambda k, t: F.when(t <= k, k + 1).otherwise(k)))
    name = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string")))
    return by.select("cluster_id", name.alias("_id"), "name", "ISSN", "variants", F.lit(run).alias("cluster_run"), "junk")


def review_sheet(names: DataFrame, least: int = 1) -> DataFrame:
    """Spellings for review: clusters by representative (empty last), its own row first, then by rows and name.

    flag marks rows that follow; band (0 or 1) changes from cluster to cluster.
    """
    rows = spellings(names)
    rep = names.groupBy("cluster_id").agg(F.min_by("raw", F.struct(-F.length("normalized"), F.col("normalized"), F.col("raw"))).alias("rep"))
    w = Window.partitionBy("cluster_id")
    rows = rows.withColumn("size", F.count("*").over(w)).filter(F.col("size") >= least).join(rep, "cluster_id")
    within = Window.partitionBy("cluster_id").orderBy((F.col("raw") != F.col("rep")).cast("int"), F.desc("n"), "raw")
    rows = rows.withColumn("place", F.row_number().over(within)).withColumn("flag", F.when(F.col("place") > 1, "+").otherwise(""))
    heads = written(rows.select("cluster_id", "rep").distinct().repartitionByRange((F.col("rep") == "").cast("int"), "rep", "cluster_id").sortWithinPartitions((F.col("rep") == "").cast("int"), "rep", "cluster_id").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "review")
    counts, at, start = heads.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect(), 0, []
    for r in counts:  # a row for each partition
        start.append((r["_part"], at))
        at += r["n"]
    offsets = names.sparkSession.createDataFrame(start, "_part int, _start long")
    number = heads.join(F.broadcast(offsets), "_part").withColumn("sheet", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    return rows.join(number.select("cluster_id", "sheet"), "cluster_id").select("sheet", "place", "cluster_id", "raw", "n", "issn", "flag", (F.col("sheet") % 2).cast("int").alias("band"))


def resolve(spellings_: DataFrame, docs: DataFrame) -> DataFrame:
    """variant, _id, name, junk of each spelling (variant) that a container lists; the first by id, if several do."""
    by = docs.select(F.explode("variants").alias("variant"), "_id", "name", "junk").groupBy("variant").agg(F.min_by(F.struct("_id", "name", "junk"), "_id").alias("d"))
    return spellings_.join(by, "variant").select("variant", "d._id", "d.name", "d.junk")
