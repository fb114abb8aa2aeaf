"""A training corpus from raw documents, in five stages.

Every stage takes the documents that its predecessor kept and returns documents (the last:
the packed pieces). Columns of the input other than those named here pass through.

Rows without a doc_id are treated like others by all stages: where a whole group of linked documents has none, one of its rows
stays. Rows that share a doc_id but not their text are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import jaccard, pii, quality
from citeloom.llm.common import fresh, table, write_shared
from citeloom.llm.queries import QUALITY_FROM, mixed, packed


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_FROM)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the least id stays; of repeated rows, one."""
    return jaccard.one_of_each(docs, "doc_id", "text", 5, 80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows. Other texts stay as they are."""
    (spans,) = fresh(docs, "pii_spans")
    found = pii.find_pii(docs, "text", spans=spans)
    hit = F.size(spans) > 0
    out = pii.redact(found, "text", spans)
    return out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    taken, _, (size, words) = mixed(docs)
    (copy,) = fresh(taken, "mix_copy")
    times = F.when(F.col(size) > 0, F.col(words) / F.col(size)).otherwise(F.lit(0)).cast("int")
    return taken.filter(F.col(words) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
