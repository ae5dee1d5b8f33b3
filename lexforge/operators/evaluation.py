"""Scoring of a question set, its checks, and calibration of the relevance threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many questions of each kind a set has, the time an answer may take, and how small a gap is narrow.
COMPOSITION = {"factual": 25, "multi": 10, "indirect": 5, "off_corpus": 5, "recency": 5}
TARGET_SECONDS, NARROW = 10.0, 0.05


def scored(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """id, refused and correct of questions(id, expected, must_refuse) by replies(id, cited, confidence, refused, seconds): a
    trap is right if refused, another if any expected reference is cited."""
    joined = questions.join(replies, "id", "left")
    refused = F.coalesce((F.col("confidence") == "insufficient") | F.col("refused"), F.lit(True))
    hit = F.coalesce(F.arrays_overlap("expected", "cited"), F.lit(False))
    return joined.select("id", "must_refuse", "seconds", refused.alias("was_refused"), F.when(F.col("must_refuse"), refused).otherwise(hit & ~refused).alias("correct"))


def failures(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """id, kind and failure ("should_refuse", "refused" or "wrong_articles") of the questions that were answered wrongly."""
    wrong = scored(questions, replies).where(~F.col("correct")).join(questions.select("id", "kind"), "id")
    return wrong.select("id", "kind", F.when(F.col("must_refuse"), "should_refuse").when(F.col("was_refused"), "refused").otherwise("wrong_articles").alias("failure"))


def report(scores: DataFrame) -> DataFrame:
    """One row: accuracy, accuracy of refusals, median and longest time, and how many took too long."""
    share = lambda c: F.avg(c.cast("int"))
    return scores.agg(
        F.count("*").alias("n"), F.round(share(F.col("correct")), 4).alias("accuracy"),
        F.round(F.avg(F.when(F.col("must_refuse"), F.col("was_refused").cast("int"))), 4).alias("refusal_accuracy"),
        F.percentile("seconds", F.lit(0.5)).alias("median_seconds"), F.max("seconds").alias("longest_seconds"), F.count_if(F.col("seconds") > TARGET_SECONDS).alias("late"),
    )


def composition(questions: DataFrame) -> DataFrame:
    """kind, n and expected of every kind that occurs or should; expected is null for unknown kinds."""
    due = questions.sparkSession.createDataFrame(sorted(COMPOSITION.items()), "kind string, expected int")
    return questions.groupBy("kind").agg(F.count("*").alias("n")).join(due, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0)).alias("n"), "expected")


def question_problems(questions: DataFrame, references: DataFrame) -> DataFrame:
    """id and problem of questions(id, kind, expected, must_refuse) against references(reference, n_texts)."""
    trap = F.col("kind") == "off_corpus"
    none = F.size("expected") == 0
    each = questions.where(~trap).select("id", F.explode("expected").alias("reference")).join(references, "reference", "left")
    found = [
        questions.where(trap & ~none).select("id", F.lit("trap_with_article").alias("problem")), questions.where(trap & ~F.col("must_refuse")).select("id", F.lit("trap_must_refuse").alias("problem")),
        questions.where(~trap & none).select("id", F.lit("no_article").alias("problem")), each.where("n_texts IS NULL").select("id", F.lit("unknown_article").alias("problem")),
        each.where("n_texts > 1").select("id", F.lit("ambiguous_article").alias("problem")),
    ]
    return reduce(DataFrame.unionAll, found).distinct()


def calibration(measured: DataFrame) -> DataFrame:
    """One row from measured(score, covered): lowest covered and highest uncovered score, gap, midpoint and verdict."""
    low, high = F.min(F.when(F.col("covered"), F.col("score"))), F.max(F.when(~F.col("covered"), F.col("score")))
    row = measured.agg(low.alias("lowest_covered"), high.alias("highest_uncovered"))
    gap = F.round(F.col("lowest_covered") - F.col("highest_uncovered"), 6)
    verdict = F.when(gap.isNull(), "undecided").when(gap <= 0, "overlap").when(gap < NARROW, "narrow").otherwise("clear")
    middle = F.when(gap > 0, F.round((F.col("lowest_covered") + F.col("highest_uncovered")) / 2, 6))
    return row.select("lowest_covered", "highest_uncovered", gap.alias("gap"), middle.alias("threshold"), verdict.alias("verdict"))
