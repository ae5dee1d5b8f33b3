"""Operators by text or user, where one of them holds most rows: block by block the results are those of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import corpus, documents, scans


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_neighbours(spark, parts):
    r = random.Random(parts)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(150)] + list(range(150))
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3]), None if r.random() < 0.6 else "2024-01-01") for i in ids]
    got = {x.id: (x.previous, x.next) for x in corpus.neighbours(spark.createDataFrame(rows, "id long, text_id int, repealed_on string"), parts).collect()}
    want = {}
    for i, t, _ in rows:
        live = sorted(j for j, u, gone in rows if u == t and gone is None and j != i)
        want[i] = (max((j for j in live if j < i), default=None), min((j for j in live if j > i), default=None))
    assert got == want


def test_neighbours_of_one_text_are_many_tasks_work(spark):
    articles = spark.range(50_000).select(F.lit(1).alias("text_id"), "id", F.lit(None).cast("date").alias("repealed_on"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = scans.in_blocks(articles, "text_id", scans.ranges(articles, "id", 20))
        sizes = [x["count"] for x in blocks.groupBy("block").count().collect()]
        tasks = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 20 and max(sizes) < 5000 and tasks > 1


def test_samples_keep_their_ends(spark):
    articles = spark.range(500).select("id", F.when(F.col("id") < 450, 1).otherwise(F.col("id")).alias("text_id"), F.lit("x").alias("content"))
    got = corpus.sampled(articles, 5, 7).collect()
    big = [x.id for x in got if x.text_id == 1]
    assert len(big) == 5 and {0, 449} <= set(big) and len(got) == 55
    assert [x.id for x in corpus.sampled(articles, 5, 7).collect()] == [x.id for x in got]
    assert {x.id for x in corpus.sampled(articles, 1, 7).where("text_id = 1").collect()} <= {0, 449}


def test_problems_of_one_huge_text(spark):
    """100,000 articles of one text: counts are whole, and samples the smallest numbers."""
    i = F.col("id")
    chunks = spark.range(100_000).select(F.lit(1).alias("doc_id"), (i % 60_000).cast("string").alias("number"), F.when(i % 10 == 0, "").otherwise("T > S").alias("path"), F.when(i % 1000 == 7, "short").otherwise("long enough " * 9).alias("content"))
    got = {x.code: (x.level, x.n, x.sample) for x in documents.problems(chunks).collect()}
    assert got["duplicate"] == ("blocking", 40_000, sorted(str(k) for k in range(40_000))[:20])
    assert got["short"] == ("blocking", 100, sorted({str(k % 60_000) for k in range(7, 100_000, 1000)})[:20])
    assert got["no_path"] == ("blocking", 10_000, sorted({str(k % 60_000) for k in range(0, 100_000, 10)})[:20])
    assert set(got) == {"duplicate", "short", "no_path"}
