"""Written intermediate tables, for loops whose lineage must not grow."""

from __future__ import annotations

import gc
import re
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Where the tables of written() lie, by the frame's identity.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where unset, a folder under /tmp for this session (on one machine only)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that all executors share")
        base = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, tag: str, codec: str = "zstd", free: bool = True) -> DataFrame:
    """The rows of df, as read back from a table in the shared folder.

    This cuts the lineage: what follows survives the loss of any executor without
    recomputing what came before. Shuffle files of what came before are released
    (free: not for small tables in loops).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if free:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, k=id(out): _PATHS.pop(k, None)), path)
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows of df, dealt evenly over all cores. For work that is long for each row: a task's share of a file is measured in bytes, and a few of those may hold very many short rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more: it removes their files then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more (what was made from them must have been written itself)."""
    for t in tables:
        _, path = _PATHS.pop(id(t))
        spark = t.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
