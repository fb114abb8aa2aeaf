"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import queries
from citeloom.llm.common import write_shared

from .conftest import SCHEMA
from .test_operators import brute_groups


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    good = (~F.col("text").rlike("changed[0-7]")) | F.col("text").isNull()
    docs.select("doc_id", good.cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    return d


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]


def test_stages(spark, docs, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = write_shared(stage(spark, now, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "near_duplicates":
            groups = brute_groups({r["doc_id"]: r["text"] for r in now.collect()})
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(k for k, (_, c) in groups.items() if c == k)
        if name == "pii":
            assert {r["doc_id"]: r["text"] for r in out.collect() if "@" not in (r["text"] or "")}.items() <= {r["doc_id"]: r["text"] for r in now.collect()}.items()
        if name == "mixing":
            taken = {r["doc_id"]: r["mix_taken"] // r["mix_size"] for r in queries.mixed(now)[0].collect() if r["mix_taken"]}
            assert Counter(r["doc_id"] for r in out.collect()) == taken
        if name == "packing":
            assert Counter(r["doc_id"] for r in out.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in now.collect())
        now = out
    assert corpus_pipeline.run(spark, sf_dir).count() == now.count()


def test_odd_rows(spark, sf_dir):
    rows = [(1, "a b c d e f g", None, None, None), (1, "a b c d e f g", None, None, None), (None, "a b c d e f g", "x", "s", 13), (None, None, None, None, None), (2, "q r s", None, "s", 5), (2, "other words", None, "s", 5), (None, "no id at all", None, "s", 5), (None, "no id at all", None, "s", 5)]
    odd = spark.createDataFrame([(*r, "k", 1, 1, "p", 900) for r in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates_stage(spark, odd, sf_dir)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, "a b c d e f g"), (None, None), (2, "q r s"), (2, "other words"), (None, "no id at all")])
    assert corpus_pipeline.pii_stage(spark, odd, sf_dir).count() == 8
    mixed = corpus_pipeline.mixing_stage(spark, odd.withColumns({"mix_size": F.lit(5), "mix_taken": F.lit(6)}), sf_dir)
    assert mixed.columns == [*odd.columns, "mix_size", "mix_taken"] and {(r["mix_copy"], r["mix_size"], r["mix_taken"]) for r in mixed.collect()} == {(900, 5, 6)}


def test_empty(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
