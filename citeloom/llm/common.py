"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.tables import discard
from citeloom.operators.tables import written as write_shared

__all__ = ["discard", "fresh", "slices", "table", "text_of", "write_shared"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(col, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts that hold at most so many bytes in a text or binary column, or one row: what is made of a part stays small."""
    values = batch.column(column)
    wide = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], wide)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, wide)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
