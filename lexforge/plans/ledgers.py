"""Registered queries: the ledger of events, the validation of deposits, and searches by many terms and in cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, deposits, ledger, replay, substrings
from ..sources.kept import shared_folder
from ..sources.readers import table
from .queries import _ARTICLES, _CANDIDATES, _TEXTS, _articles, _date, _live, _questions, _texts, registered
from .registers import _PEOPLE, _people

_CREDITS = "CASE {} WHEN 'essentiel' THEN 90 WHEN 'cabinet' THEN 150 WHEN 'essai' THEN 1 ELSE 10 END"


@registered(f"""WITH RECURSIVE {_PEOPLE},
    e AS (
        SELECT event_id, user_id, moment, CAST(moment AS DATE) AS day, kind, CASE WHEN kind = 'plan' THEN ['gratuit', 'essentiel', 'cabinet', 'essai'][CAST(event_id % 4 + 1 AS INTEGER)] END AS code,
            CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS months, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n
        FROM (SELECT event_id, user_id, ts + to_days(CAST(event_id * 7 % 90 AS INTEGER)) AS moment, CASE event_type WHEN 'purchase' THEN 'plan' WHEN 'error' THEN 'unanswered' ELSE 'answered' END AS kind FROM events)),
    r AS (
        SELECT user_id, role IN ('juriste', 'admin') AS staff, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(plan AS VARCHAR) AS plan, CASE WHEN user_id % 4 > 0 THEN DATE '2024-01-20' + CAST(user_id % 40 AS INTEGER) END AS ends,
            CAST(user_id % 12 AS BIGINT) AS quota, DATE '2023-12-15' + CAST(user_id % 40 AS INTEGER) AS set_on, CAST(NULL AS BOOLEAN) AS allowed, 0 AS cost FROM people
        UNION ALL
        SELECT user_id, staff, n, event_id, CASE WHEN kind = 'plan' THEN code ELSE plan END, CASE WHEN kind = 'plan' THEN day + 30 * months ELSE ends END,
            CASE WHEN kind = 'plan' THEN {_CREDITS.format("code")} * months ELSE quota - cost END, CASE WHEN kind = 'plan' THEN day ELSE set_on END, allowed, cost
        FROM (
            SELECT *, CASE WHEN kind <> 'plan' THEN staff OR quota > 0 END AS allowed, CASE WHEN kind = 'answered' AND NOT staff AND quota > 0 THEN 1 ELSE 0 END AS cost
            FROM (
                SELECT user_id, staff, n, event_id, kind, code, months, day, CASE WHEN ended THEN 'gratuit' ELSE plan END AS plan, CASE WHEN NOT ended THEN ends END AS ends,
                    CASE WHEN ended THEN 10 WHEN month THEN {_CREDITS.format("plan")} ELSE quota END AS quota, CASE WHEN ended OR month THEN day ELSE set_on END AS set_on
                FROM (
                    SELECT r.user_id, staff, e.n, e.event_id, kind, code, months, day, plan, ends, quota, set_on,
                        coalesce(plan <> 'gratuit' AND ends < day, false) AS ended, set_on IS NULL OR date_trunc('month', set_on) < date_trunc('month', day) AS month
                    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))))
    SELECT event_id, user_id, plan, allowed, CAST(cost AS INTEGER) AS cost, quota FROM r WHERE n > 0""")
def quota_ledger(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("user_id"), F.col("event_id")
    users = _people(spark, sf).withColumns({"plan_ends": F.when(k % 4 > 0, F.date_add(_date("2024-01-20"), (k % 40).cast("int"))), "quota": (k % 12).cast("int"), "quota_set_on": F.date_add(_date("2023-12-15"), (k % 40).cast("int"))})
    kind = F.when(F.col("event_type") == "purchase", "plan").when(F.col("event_type") == "error", "unanswered").otherwise("answered")
    code = F.element_at(F.array(*map(F.lit, ("gratuit", "essentiel", "cabinet", "essai"))), (i % 4 + 1).cast("int"))
    events = table(spark, sf, "events").select("event_id", "user_id", F.expr("ts + make_dt_interval(CAST(event_id * 7 % 90 AS INT))").alias("at"), kind.alias("kind"), F.when(F.col("event_type") == "purchase", code).alias("code"), F.when(i % 3 == 0, 2).otherwise(1).alias("months"))
    return replay.replayed_quotas(users, events, ledger.plans(spark))


@registered(f"""WITH {_PEOPLE}, w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark UNION SELECT right(c_name, 4) FROM customer WHERE c_custkey % 5 = 0 UNION SELECT unnest(['custom', 'le', 'ad', 'z@', '#0000', 'juriste', 'org']))
    SELECT term, user_id FROM w JOIN people ON contains(lower(email), term) OR contains(role, term) WHERE term <> ''""")
def people_by_words(spark: SparkSession, sf: str) -> DataFrame:
    people = _people(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term"))
    asked = asked.unionAll(table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.right("c_name", F.lit(4)))).unionAll(spark.createDataFrame([(t,) for t in ("custom", "le", "ad", "z@", "#0000", "juriste", "org")], "term string"))
    return substrings.containing(people, "user_id", {"email": F.lower("email"), "role": F.col("role")}, asked)


#: Cells of the registered index; so many probes are all of them, which shows that every vector is in one.
_CELLS = 16


@registered(f"WITH {_CANDIDATES} SELECT question_id, id, score, rank FROM v")
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    vectors = _live(spark, sf).where("embedding IS NOT NULL").select("id", "embedding")
    cells.build(vectors.where("id % 3 > 0"), path, _CELLS)
    cells.add(vectors.where("id % 3 = 0"), path)
    return cells.search(path, _questions(spark, sf), 20, _CELLS).select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@registered(f"""WITH {_TEXTS}, {_ARTICLES},
    d AS (SELECT s_suppkey AS deposit_id, 'S' || s_suppkey % 4 AS acronym, DATE '2024-07-01' + CAST(s_suppkey AS INTEGER) AS dated, s_suppkey % 7 <> 3 AS pending, s_suppkey % 5 = 4 AS blocked, s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 AS unread FROM supplier),
    ok AS (SELECT *, row_number() OVER (ORDER BY deposit_id) + (SELECT max(id) FROM texts) AS text_id, lead(dated) OVER (PARTITION BY acronym ORDER BY deposit_id) AS ends FROM d WHERE pending AND NOT blocked AND NOT unread),
    first AS (SELECT acronym, arg_min(dated, deposit_id) AS dated FROM ok GROUP BY acronym)
    SELECT a.id, a.text_id, number, CAST(NULL AS VARCHAR) AS effective_on, CAST(coalesce(repealed_on, f.dated) AS VARCHAR) AS repealed_on FROM articles a JOIN texts t ON t.id = a.text_id LEFT JOIN first f USING (acronym)
    UNION ALL SELECT row_number() OVER (ORDER BY deposit_id, doc_id) + (SELECT max(id) FROM articles), ok.text_id, 'd' || doc_id, CAST(dated AS VARCHAR), CAST(ends AS VARCHAR) FROM ok JOIN documents ON doc_id % 10 = deposit_id""")
def deposits_validated(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("doc_id")
    held = table(spark, sf, "supplier").select(
        k.alias("deposit_id"), F.concat(F.lit("S"), (k % 4).cast("string")).alias("acronym"), F.concat(F.lit("d"), k.cast("string")).alias("version"), F.date_add(_date("2024-07-01"), k.cast("int")).alias("dated"),
        F.when(k % 7 == 3, "rejected").otherwise("pending").alias("status"), F.when(k % 2 == 1, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1"))).alias("reviewed"),
        F.lit(None).cast("long").alias("decided_by"), F.lit(None).cast("date").alias("decided_at"), F.lit(None).cast("long").alias("text_id"),
    )
    found = held.select("deposit_id", F.when(F.col("deposit_id") % 5 == 4, "blocking").otherwise("warning").alias("level"))
    read = held.where("deposit_id % 3 = 2").select("deposit_id", F.explode(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(s).alias("status")) for n, s in (("1", "changed"), ("2", "added"), ("3", "unchanged"))))).alias("c")).select("deposit_id", "c.*")
    chunks = table(spark, sf, "documents").select((i % 10).alias("deposit_id"), i.alias("seq"), F.concat(F.lit("d"), i.cast("string")).alias("number"), F.col("lang").alias("path"), F.col("text").alias("content"))
    outcomes = deposits.validation_outcomes(held, found, read, held.select("deposit_id", F.lit(1).cast("long").alias("actor")))
    articles = _articles(spark, sf).withColumn("effective_on", F.lit(None).cast("date"))
    _, after, _ = deposits.validated(held, chunks, _texts(spark, sf), articles, outcomes, _date("2024-09-01"))
    return after.select("id", "text_id", "number", F.col("effective_on").cast("string").alias("effective_on"), F.col("repealed_on").cast("string").alias("repealed_on"))
