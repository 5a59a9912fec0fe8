"""The registered queries: against their SQL, and by contract on whole tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm.queries import ORACLE, QUERIES
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_keeps_the_columns_and_follows_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    texts = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "mix_sources":
            texts = {(r.doc_id, r.text) for r in docs.collect()}
    packed = docs.orderBy("doc_id", "chunk").collect()
    assert {r.doc_id for r in packed} == {d for d, _ in texts}
    assert sum(r.n_tokens for r in packed) > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
