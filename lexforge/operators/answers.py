"""From ranked results to an answer: context, citation checks and the decision to refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import courtesy_kind, excerpt, leading_key, numbered_items, upper_first
from .retrieval import LEAST_RELEVANCE

# Fixed values.
WITHOUT_MODEL, EXCERPT, MOST_SUMMARIES, TO_COMPLETE = 5, 600, 60, "[À COMPLÉTER]"


def context_block() -> Column:
    head = F.concat(F.lit("[ARTICLE id="), F.col("id").cast("string"), F.lit("] "), F.col("acronym"), F.lit(" - Article "), F.col("number"))
    return F.concat_ws("\n", head, F.when(F.trim("path") != "", F.col("path")), F.col("content"))


def contexts(results: DataFrame) -> DataFrame:
    """question_id and context: the blocks of results(question_id, rank, id, acronym, number, path, content) in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", context_block().alias("block"))))
    return results.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def user_messages(context: DataFrame, questions: DataFrame, turns: DataFrame) -> DataFrame:
    """question_id and message: articles, the last turns if there are any, and the question."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))))
    thread = turns.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "\n").alias("thread"))
    joined = questions.join(context, "question_id", "left").join(thread, "question_id", "left")
    return joined.select("question_id", F.concat_ws("\n\n", F.concat(F.lit("ARTICLES\n"), F.col("context")), F.concat(F.lit("THREAD\n"), F.col("thread")), F.concat(F.lit("QUESTION\n"), F.col("question"))).alias("message"))


def valid_citations(citations: DataFrame, results: DataFrame) -> DataFrame:
    """Citations(question_id, position, id, extract) whose article is among the question's results, with the corpus's own
    reference fields; of several of the same article the first."""
    first = Window.partitionBy("question_id", "id").orderBy("position")
    once = citations.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return once.join(results.select("question_id", "id", "acronym", "number", "path"), ["question_id", "id"])


def rejected_citations(citations: DataFrame, results: DataFrame) -> DataFrame:
    return citations.join(results.select("question_id", "id"), ["question_id", "id"], "left_anti")


def decisions(answers: DataFrame, citations: DataFrame, results: DataFrame) -> DataFrame:
    """question_id, n_valid and refused for answers(question_id, confidence, refused_by_model): refused by the model, or
    citing nothing valid while citing something or claiming some confidence, or insufficient and citing nothing."""
    cited = citations.groupBy("question_id").agg(F.count("*").alias("n_cited"))
    valid = valid_citations(citations, results).groupBy("question_id").agg(F.count("*").alias("n_valid"))
    joined = answers.join(cited, "question_id", "left").join(valid, "question_id", "left").fillna(0, ["n_cited", "n_valid"])
    none = F.col("n_valid") == 0
    refused = F.when(F.coalesce("refused_by_model", F.lit(False)), True).when((F.col("n_cited") > 0) & none, True).when((F.col("confidence") != "insufficient") & none, True)
    return joined.select("question_id", "n_valid", refused.otherwise(none).alias("refused"))


def pre_checks(questions: DataFrame, relevance: DataFrame, least: float = LEAST_RELEVANCE) -> DataFrame:
    """question_id and route of questions(question_id, question, mode, n_results): "courtesy", "refuse" without results or
    with too little relevance in hybrid mode, else "answer"."""
    joined = questions.join(relevance, "question_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    route = F.when(courtesy_kind(F.col("question")).isNotNull(), "courtesy").when(F.col("n_results") == 0, "refuse")
    return joined.select("question_id", route.when((F.col("mode") == "hybrid") & (F.col("relevance") < least), "refuse").otherwise("answer").alias("route"))


def without_model(results: DataFrame) -> DataFrame:
    """What is shown while no model is configured: the first articles, shortened, with a warning in lexical mode."""
    kept = results.where(F.col("rank") <= WITHOUT_MODEL)
    return kept.select("question_id", "rank", "id", excerpt(F.col("content"), EXCERPT, "...").alias("extract"), (F.col("mode") == "lexical_only").alias("warned"))


def charges(answered: DataFrame) -> DataFrame:
    """question_id, allowed and cost of answered(question_id, staff, quota, refused, synthesised)."""
    allowed = F.col("staff") | (F.col("quota") > 0)
    free = F.col("refused") | ~F.col("synthesised") | F.col("staff")
    return answered.select("question_id", allowed.alias("allowed"), F.when(allowed & ~free, 1).otherwise(0).alias("cost"))


def to_summarise(diff: DataFrame) -> DataFrame:
    """The changed rows of diffs(deposit_id, status, …), none of a deposit that changes too many."""
    changed = diff.where("status = 'changed'")
    few = changed.groupBy("deposit_id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_SUMMARIES)
    return changed.join(few.select("deposit_id"), "deposit_id", "left_semi")


def checklist(articles: DataFrame, replies: DataFrame) -> DataFrame:
    """article_id, position, mark, label, status and finding of every item of articles(article_id, content), by the first of
    replies(article_id, position, mark, status, finding) with its number; without one, or with an unknown status, to check."""
    points = articles.select("article_id", F.posexplode(numbered_items(F.col("content"))).alias("position", "item")).select("article_id", "position", "item.mark", "item.label")
    points = points.withColumn("key", leading_key(F.col("mark")))
    first = Window.partitionBy("article_id", "key").orderBy("position")
    said = replies.withColumn("key", leading_key(F.col("mark"))).withColumn("r", F.row_number().over(first)).where("r = 1").select("article_id", "key", "status", "finding")
    known = F.col("status").isin("conforming", "gap", "to_check")
    return points.join(said, ["article_id", "key"], "left").select("article_id", "position", "mark", "label", F.when(known, F.col("status")).otherwise("to_check").alias("status"), F.coalesce("finding", F.lit("Not verified.")).alias("finding"))


def questionnaire(articles: DataFrame) -> DataFrame:
    """article_id, position (from 1), key, mark, question and label: a field for each item of an article."""
    points = articles.select("article_id", F.posexplode(numbered_items(F.col("content"))).alias("p", "item"))
    number = F.rtrim(F.translate("item.mark", "°", ""))
    return points.select("article_id", (F.col("p") + 1).alias("position"), F.concat(F.lit("item_"), number).alias("key"), "item.mark", upper_first(F.col("item.label")).alias("question"), "item.label")


def clauses(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Fields with content and complete; an unanswered one is shown as to be completed."""
    said = F.trim(F.coalesce("answer", F.lit("")))
    joined = fields.join(answers.select("article_id", "key", "answer"), ["article_id", "key"], "left")
    return joined.select("article_id", "position", "mark", "label", F.when(said != "", said).otherwise(TO_COMPLETE).alias("content"), (said != "").alias("complete"))
