"""Incremental clustering: records that arrive on a stream join the clusters of their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import linkage
from citeloom.sources import csl


class Worker:
    """Keeps works in a folder of generations; each micro-batch writes the next one.

    A batch touches the blocks of its own records: pairs, features and decisions are made there only,
    and the clusters they join are relabelled by their least id. A generation counts once its writer has marked it complete; a batch
    folds into the last complete one before its own number, so a batch that is repeated after a failure gives the same
    generation, and a new worker goes on where an earlier one stopped.
    """

    def __init__(self, spark: SparkSession, path: str, date_precision: int = 0):
        self.spark, self.path, self.date_precision = spark, path, date_precision
        self.generation = self._last(1 << 62)

    def _last(self, before: int) -> int:
        """The last complete generation before this number; -1 if there is none."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
        found = [int(n[4:]) for n in names if n.startswith("gen=") and int(n[4:]) < before]
        done = [g for g in found if store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen={g}/_SUCCESS"))]
        return max(done, default=-1)

    def works(self, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/gen={self.generation if generation is None else generation}")

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch of works."""
        before = self._last(batch_id)
        old = self.works(before) if before >= 0 else batch.limit(0)
        rows = csl.upsert(old, batch).persist()
        fresh = batch.select("_id").distinct()
        pairs = linkage.ladder_pairs(rows)
        touched = pairs.join(fresh.select(F.col("_id").alias("a")), "a", "left_semi").unionByName(pairs.join(fresh.select(F.col("_id").alias("b")), "b", "left_semi").select(pairs.columns)).distinct()
        matches = linkage.compare(touched, rows, self.date_precision).filter("match").select("a", "b")
        known = rows.filter(F.col("cluster") != F.col("_id")).join(fresh, "_id", "left_anti").select(F.col("_id").alias("a"), F.col("cluster").alias("b"))
        labels = linkage.cluster(rows, matches.unionByName(known)).withColumnRenamed("cluster", "_cluster")
        out = rows.join(labels, "_id").withColumn("cluster", F.col("_cluster")).select(rows.columns)
        out.write.mode("overwrite").parquet(f"{self.path}/gen={batch_id}")
        rows.unpersist()
        self.generation = batch_id

    def start(self, stream: DataFrame, checkpoint: str):
        """A query that folds a stream of works."""
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_feed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest visit by record and day, from a stream of visits (ts, user_id), with late ones dropped after the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id").agg(F.max("ts").alias("visited"))
