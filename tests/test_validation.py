import datetime
import glob

import pytest
from pyspark.sql import functions as F

from lexforge.operators import deposits
from lexforge.sources import writers

D = datetime.date


def tables(spark):
    held = spark.createDataFrame(
        [(1, "A", "v2", D(2024, 2, 1), "pending", ["1", "2"]), (2, "A", "v3", D(2024, 3, 1), "pending", None), (3, "B", "v2", D(2024, 4, 1), "pending", ["1"]), (4, "B", "v3", D(2024, 5, 1), "pending", None), (5, "B", "v4", D(2024, 6, 1), "valid", None)],
        "deposit_id long, acronym string, version string, dated date, status string, reviewed array<string>",
    ).withColumns({"decided_by": F.lit(None).cast("long"), "decided_at": F.lit(None).cast("date"), "text_id": F.lit(None).cast("long")})
    texts = spark.createDataFrame([(10, "A", "v1", D(2020, 1, 1)), (11, "B", "v1", D(2020, 1, 1))], "id long, acronym string, version string, dated date")
    rows = [(100, 10, "1", "p", "old", D(2020, 1, 1), None), (101, 10, "2", "p", "gone", D(2020, 1, 1), D(2021, 1, 1)), (102, 11, "1", "p", "old", D(2020, 1, 1), None)]
    articles = spark.createDataFrame(rows, "id long, text_id long, number string, path string, content string, effective_on date, repealed_on date")
    chunks = spark.createDataFrame([(1, 0, "1", "p", "a"), (1, 1, "2", "p", "b"), (2, 5, "1", "p", "c"), (3, 0, "1", "p", "d"), (4, 0, "1", "p", "e")], "deposit_id long, seq int, number string, path string, content string")
    found = spark.createDataFrame([(4, "blocking"), (1, "warning")], "deposit_id long, level string")
    read = spark.createDataFrame([(1, "1", "changed"), (1, "2", "added"), (3, "1", "changed"), (3, "9", "repealed")], "deposit_id long, number string, status string")
    return held, chunks, texts, articles, found, read


@pytest.mark.parametrize("places", [1, 10_000])
def test_validation(spark, monkeypatch, places):
    monkeypatch.setattr(deposits, "PLACES", places)
    held, chunks, texts, articles, found, read = tables(spark)
    who = spark.createDataFrame([(k, 7) for k in (1, 2, 3, 4, 5, 6)], "deposit_id long, actor long")
    outcomes = deposits.validation_outcomes(held, found, read, who)
    assert {x.deposit_id: x.outcome for x in outcomes.collect()} == {1: "valid", 2: "valid", 3: "unreviewed", 4: "blocked", 5: "not_pending", 6: "unknown"}
    new_texts, after, decided = deposits.validated(held, chunks, texts, articles, outcomes, F.to_date(F.lit("2024-09-01")))
    assert {(x.id, x.acronym, x.version) for x in new_texts.where("id > 11").collect()} == {(12, "A", "v2"), (13, "A", "v3")}
    got = {x.id: (x.text_id, x.content, x.effective_on, x.repealed_on) for x in after.collect()}
    assert got == {
        100: (10, "old", D(2020, 1, 1), D(2024, 2, 1)), 101: (10, "gone", D(2020, 1, 1), D(2021, 1, 1)), 102: (11, "old", D(2020, 1, 1), None),
        103: (12, "a", D(2024, 2, 1), D(2024, 3, 1)), 104: (12, "b", D(2024, 2, 1), D(2024, 3, 1)), 105: (13, "c", D(2024, 3, 1), None),
    }
    assert {x.deposit_id: (x.status, x.decided_by, x.text_id) for x in decided.collect()} == {1: ("valid", 7, 12), 2: ("valid", 7, 13), 3: ("pending", None, None), 4: ("pending", None, None), 5: ("valid", None, None)}
    # once more changes nothing
    again = deposits.validation_outcomes(decided, found, read, who.where("deposit_id < 3"))
    assert {x.outcome for x in again.collect()} == {"not_pending"}
    same = deposits.validated(decided, chunks, new_texts, after, again, F.to_date(F.lit("2024-10-01")))
    assert [sorted(map(str, t.collect())) for t in same] == [sorted(map(str, t.collect())) for t in (new_texts, after, decided)]


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "corpus")
    one, two = spark.createDataFrame([(1, "a"), (1, "a")], "id int, t string"), spark.createDataFrame([(2, None)], "id int, t string")
    first = writers.publish({"texts": one, "articles": two}, root)
    assert writers.published(spark, root, "texts").count() == 2
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("midway"))).alias("id"))
    with pytest.raises(Exception, match="midway"):
        writers.publish({"texts": spark.createDataFrame([(9, "z")], "id int, t string"), "articles": broken}, root)
    assert [x.id for x in writers.published(spark, root, "texts").collect()] == [1, 1]
    assert len(glob.glob(f"{root}/version-*")) == 2
    second = writers.publish({"texts": two, "articles": one}, root)
    assert second != first and [x.id for x in writers.published(spark, root, "texts").collect()] == [2]
    empty = writers.publish({"texts": one.where("id > 5")}, root)
    assert empty and writers.published(spark, root, "texts").count() == 0
