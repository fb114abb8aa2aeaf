"""What __spark_entry__.py adds: the queries of this package and the pipeline."""

import corpus_pipeline
from citeloom.llm.queries import ORACLES, QUERIES as OPERATORS

__all__ = ["ORACLES", "QUERIES"]

QUERIES = OPERATORS | {"pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLES = ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
