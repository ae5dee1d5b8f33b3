import duckdb
import pytest
from oracle import rows

from lexforge.catalogue import ORACLES, QUERIES

TEXTS = [(1, None), (2, ""), (3, " "), (4, "La forme; 2° le nom."), (5, "|;.|"), (6, None), (7, "é😀" * 30), (None, "no id"), (None, None)]


@pytest.mark.parametrize("name", ["questionnaires", "clauses_filled"])
def test_articles_without_text_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) == 2 * len(TEXTS) and rows(got) == rows(con.execute(ORACLES[name]).df())
