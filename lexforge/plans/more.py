"""Registered queries: sources and sinks written and read again, streams run to their end, layout and small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, layout, ledger, retrieval, rules
from ..sources import readers, writers
from ..sources.kept import shared_folder
from ..sources.readers import table
from ..streaming import vectorise
from .queries import _articles, _pages, _questions, registered
from .registers import _PEOPLE, _people


@registered("""SELECT doc_id AS id, len(list_distinct(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: length(w) >= 2))) AS n_tokens FROM documents""")
def articles_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Written in two appends and read again."""
    path, held = shared_folder(spark), _articles(spark, sf)
    for rest in (0, 1):
        writers.append_articles(held.where(F.col("id") % 2 == rest), path)
    return spark.read.parquet(path).select("id", F.size("tokens").cast("long").alias("n_tokens"))


@registered("SELECT vec_id AS id, CAST(round(embedding[1], 3) AS VARCHAR) IS NOT NULL AS scored, vec_id % 2 = 0 AS covered FROM embeddings")
def scores_written(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    writers.write_scores(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).alias("score"), (F.col("vec_id") % 2 == 0).alias("covered")), path)
    return spark.read.schema("id long, score double, covered boolean").csv(path, header=True).select("id", F.col("score").isNotNull().alias("scored"), "covered")


@registered("""SELECT CAST(substr(source, 4) AS BIGINT) AS text_id, doc_id AS id, md5('Article ' || doc_id % 400 || chr(10) || lang || chr(10) || text || chr(10) || '[ ] conforming   [ ] to correct') AS sheet FROM documents""")
def reading_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return writers.reading_sheet(_articles(spark, sf)).select("text_id", "id", F.md5("sheet").alias("sheet"))


@registered("SELECT CAST(item_id AS INTEGER) AS id, text AS question, item_id % 5 = 0 AS doit_refuser FROM benchmark")
def questions_read(spark: SparkSession, sf: str) -> DataFrame:
    """Question sets written as JSON arrays, one a file, with headings without an id, and read again."""
    path, asked = shared_folder(spark), table(spark, sf, "benchmark")
    rows = asked.select(F.col("item_id").cast("int").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 5 == 0).alias("doit_refuser"))
    both = rows.withColumn("part", F.col("id") % 4).unionByName(rows.where("id % 10 = 0").select(F.lit(None).cast("int").alias("id"), "question", "doit_refuser", (F.col("id") % 4).alias("part")))
    both.groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "question", "doit_refuser"))).alias("value")).write.partitionBy("part").text(path)
    return readers.questions(spark, f"{path}/part=*").select("id", "question", "doit_refuser")


@registered("SELECT doc_id AS id, length(text) AS chars FROM documents WHERE doc_id % 3 > 0")
def vectors_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Articles without a vector get one from a stream that is run to its end; here a vector says how long its text is."""
    source, out, state = (shared_folder(spark) for _ in range(3))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0.0))).alias("embedding"))
    docs.write.parquet(source)
    vectorise.vectorise_stream(spark.readStream.schema(docs.schema).parquet(source), lambda texts: [[float(len(t))] for t in texts], 1, out, state).awaitTermination()
    return spark.read.schema("id long, embedding array<double>").parquet(f"{out}/batch=*").select("id", F.get("embedding", F.lit(0)).cast("long").alias("chars"))


@registered("""SELECT doc_id, CASE WHEN length(c) >= 8 AND length(c) <= 10 * greatest(length(o), 40) THEN c ELSE o END AS asked FROM (
    SELECT doc_id, trim(text) AS c, 'question ' || doc_id AS o FROM documents)""")
def expansions_guarded(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.concat(F.lit("question "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", retrieval.guarded(F.col("text"), asked, retrieval.EXPANSION_BOUNDS).alias("asked"))


@registered("SELECT doc_id, doc_id % 3 = 0 AS verified FROM documents")
def brackets_verified(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    stated = F.concat(F.lit(" jusqu'à 2 000 000 : 10 % ; 3.000.000 : 15% ; 5 000 000 : "), F.when(i % 3 == 1, "26").otherwise("25"), F.lit(" pour cent ; au-delà : 35"), F.when(i % 3 == 2, ",5 %").otherwise(" %"))
    return table(spark, sf, "documents").select("doc_id", rules.verified_brackets(None, F.concat(F.translate("text", "0123456789", ""), stated)).alias("verified"))


@registered("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'S' || item_id || ' ' || item_id || ' bis' WHEN 1 THEN 'S1 ' || item_id END AS reference FROM benchmark")
def expected_references(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("item_id"), F.col("item_id").cast("string")
    written = F.when(i % 3 == 0, F.concat(F.lit("  s"), n, F.lit(" \t "), n, F.lit(" bis "))).when(i % 3 == 1, F.concat(F.lit("S1 "), n)).otherwise(n)
    return table(spark, sf, "benchmark").select("item_id", T.expected_reference(written).alias("reference"))


@registered(f"""WITH {_PEOPLE} SELECT o_orderkey AS request_id, p.user_id, email FROM orders JOIN people p ON p.user_id = o_custkey WHERE o_orderstatus = 'P' AND o_orderkey % 4 > 0""")
def requests_to_treat(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders").where("o_orderkey % 4 > 0"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("validated")
    requests = o.select(k.alias("request_id"), F.when(k % 9 == 0, F.col("o_custkey") + 0).otherwise(F.col("o_custkey")).alias("user_id"), F.lit("cabinet").alias("code"), status.alias("status"), F.col("o_orderdate").alias("asked_at"))
    return ledger.requests_with_users(requests, _people(spark, sf)).select("request_id", "user_id", "email")


@registered("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 > 0 THEN 'pending' ELSE 'treated' END AS part FROM orders""")
def requests_parted(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus"))
    chosen, rest = ledger.parted(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")), F.col("status") == "O")
    return chosen.select("id", F.lit("pending").alias("part")).unionAll(rest.select("id", F.lit("treated").alias("part")))


@registered("""WITH s AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS doc_id, upper(source) AS name FROM documents), n AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, count(*) AS n FROM documents GROUP BY 1)
    SELECT doc_id, CASE WHEN n >= 4 THEN 'COLLECTION ' || name || '|Published for the collection, page' ELSE '' END AS removed FROM s JOIN n USING (doc_id)""")
def cleaning_told(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.cleaning_diagnostics(_pages(spark, sf))
    return found.select("doc_id", F.array_join(F.filter("removed", lambda x: x.startswith("COLLECTION") | x.startswith("Published")), "|").alias("removed"))


_WORDS = "string_split_regex(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' +')"


@registered(f"""WITH w AS (SELECT doc_id, list_slice(list_filter({_WORDS}, lambda x: x <> ''), 1, 40) AS w FROM documents),
    l AS (SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 THEN w[2 * k + 1] || ' ' || w[2 * k + 2] ELSE w[4 * (k % 10) + 2 * (k // 10) + 1] || ' ' || w[4 * (k % 10) + 2 * (k // 10) + 2] END AS line FROM (SELECT *, unnest(range(0, 20)) AS k FROM w WHERE len(w) = 40))
    SELECT doc_id, CAST(k AS INTEGER) AS line_no, line FROM l""")
def lines_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 words of every document as boxes on a page: two to a line, or, in every other document, lines of two
    columns of two words, which are read one column after the other."""
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " +"), lambda w: w != "")
    held = table(spark, sf, "documents").select("doc_id", F.slice(words, 1, 40).alias("w")).where(F.size("w") == 40).select("doc_id", F.posexplode("w").alias("i", "text"))
    i, even = F.col("i"), F.col("doc_id") % 2 == 0
    column = F.when(even, F.lit(0)).otherwise(F.floor(i / 2) % 2)
    x0 = F.when(even, 40.0 + (i % 2) * 300).otherwise(40.0 + (i % 2) * 70 + column * 260)
    top = F.when(even, F.floor(i / 2) * 20.0).otherwise(F.floor(i / 4) * 20.0)
    boxes = held.select("doc_id", F.lit(1).alias("page_no"), x0.alias("x0"), (x0 + F.when(even, 290.0).otherwise(60.0)).alias("x1"), top.cast("double").alias("top"), "text", F.lit(620.0).alias("width"))
    return layout.page_lines(boxes).select("doc_id", "line_no", "line")
