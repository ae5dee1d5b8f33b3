"""Every registered query outside the llm subpackage against its SQL."""

import pytest
from oracle import FOLDER, compare

from lexforge.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_pending_vectors_has_all(spark):
    folder = "/root/testdata/sf0.01"
    docs, vectors = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "embeddings"))
    waiting = docs.where("doc_id % 7 <> 0").join(vectors.where("embedding IS NOT NULL").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left_anti")
    want = sorted(r.doc_id for r in waiting.select("doc_id").collect())
    assert len(want) > 100 and [r.id for r in QUERIES["pending_vectors"](spark, folder).collect()] == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
