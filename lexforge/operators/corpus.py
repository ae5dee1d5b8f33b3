"""Reports over a versioned corpus and the conversations about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

#: Articles of a range that are read together, and the most ranges.
RANGE, MOST_RANGES = 100_000, 200
# Fixed values.
TURNS, HIGHLIGHTS, JOURNAL_ROWS, REGISTER_ROWS = 6, 8, 50, 200


def provenance(texts: DataFrame, articles: DataFrame) -> DataFrame:
    """acronym, dated, articles and vectorised of each text: counts of articles in force; texts without any stay."""
    live = articles.where("repealed_on IS NULL").groupBy("text_id").agg(F.count("*").alias("a"), F.count("embedding").alias("v"))
    joined = texts.join(live.withColumnRenamed("text_id", "id"), "id", "left")
    return joined.select("id", "acronym", "dated", F.coalesce("a", F.lit(0)).alias("articles"), F.coalesce("v", F.lit(0)).alias("vectorised")).orderBy("acronym", F.desc("dated"))


def readiness(texts: DataFrame, articles: DataFrame) -> DataFrame:
    """id, articles, vectorised and ready, over all articles, closed ones included."""
    counts = articles.groupBy("text_id").agg(F.count("*").alias("a"), F.count("embedding").alias("v"))
    joined = texts.join(counts.withColumnRenamed("text_id", "id"), "id", "left").select("id", F.coalesce("a", F.lit(0)).alias("articles"), F.coalesce("v", F.lit(0)).alias("vectorised"))
    return joined.withColumn("ready", (F.col("articles") > 0) & (F.col("articles") == F.col("vectorised")))


def pending_vectors(articles: DataFrame, texts: DataFrame, acronym: str | None = None, limit: int | None = None) -> DataFrame:
    waiting = articles.where("embedding IS NULL AND repealed_on IS NULL").join(texts.select(F.col("id").alias("text_id"), "acronym"), "text_id")
    waiting = waiting.where(F.col("acronym") == acronym) if acronym else waiting
    ordered = waiting.orderBy("id")
    return ordered.limit(limit) if limit else ordered


def with_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """articles with the vectors of vectors(id, embedding) written over theirs."""
    new = vectors.select("id", F.col("embedding").alias("__new"))
    return articles.join(new, "id", "left").select(*(F.coalesce("__new", "embedding").alias("embedding") if c == "embedding" else F.col(c) for c in articles.columns))


def article_of(articles: DataFrame, texts: DataFrame, acronym: str, number: str) -> DataFrame:
    """The article in force with a number; of several the one with the smallest id."""
    live = articles.where((F.col("number") == number) & F.col("repealed_on").isNull())
    return live.join(texts.where(F.col("acronym") == acronym).select(F.col("id").alias("text_id")), "text_id", "left_semi").orderBy("id").limit(1)


def neighbours(articles: DataFrame, parts: int | None = None) -> DataFrame:
    """id, previous and next article in force of the same text, for articles in force and closed ones.

    A text's articles are read in ranges of ids, each of which is told what stands at the ends of the others; parts: how
    many, by default one for each RANGE articles."""
    parts = parts or max(1, articles.count() // RANGE)
    live = F.when(F.col("repealed_on").isNull(), F.col("id"))
    blocks = scans.in_blocks(articles.select("text_id", "id", "repealed_on"), "text_id", scans.ranges(articles, "id", min(parts, MOST_RANGES)))
    return scans.scanned(blocks, "text_id", "id", previous={"previous": live}, following={"next": live}).select("id", "previous", "next")


def outline(articles: DataFrame) -> DataFrame:
    """text_id, path, first_id and numbers (in order of ids) of each path, in order of first appearance."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "number"))), lambda x: x["number"])
    return articles.groupBy("text_id", "path").agg(F.min("id").alias("first_id"), listed.alias("numbers")).orderBy("text_id", "first_id")


def last_turns(messages: DataFrame, n: int = TURNS) -> DataFrame:
    """The last n of messages(conversation_id, message_id, …) of each conversation, to be read in order of ids."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n).drop("back")


def previous_question(messages: DataFrame) -> DataFrame:
    """messages with question: the last user turn before each in its conversation."""
    before = Window.partitionBy("conversation_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def turn_before_by_another(messages: DataFrame) -> DataFrame:
    """messages with other: the last turn before each by another role.

    That is the last turn before the run of the same role that the message is in."""
    by = Window.partitionBy("conversation_id").orderBy("message_id")
    changed = messages.withColumns({"__before": F.lag("text").over(by), "__starts": ~F.col("role").eqNullSafe(F.lag("role").over(by))})
    return changed.withColumn("other", F.last(F.when(F.col("__starts"), F.struct("__before")), ignorenulls=True).over(by)["__before"]).drop("__before", "__starts")


def conversations_nested(conversations: DataFrame, messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Each conversation with its messages in order, each with its citations in order."""
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list("article_id")).alias("citations"))
    full = messages.join(cited, "message_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<long>")))
    nested = full.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", "text", "citations"))).alias("messages"))
    return conversations.join(nested, "conversation_id", "left")


def citation_counts(citations: DataFrame, articles: DataFrame) -> DataFrame:
    """text_id and n: citations of each text's articles."""
    return citations.join(articles.select(F.col("id").alias("article_id"), "text_id"), "article_id").groupBy("text_id").agg(F.count("*").alias("n"))


def report_register(reports: DataFrame, users: DataFrame, messages: DataFrame, rows: int = REGISTER_ROWS) -> DataFrame:
    """Reports with their authors and answers, if these still exist, open ones first, then the latest."""
    joined = reports.join(users.select("user_id", "email"), "user_id", "left").join(messages.select("message_id", F.col("text").alias("answer")), "message_id", "left")
    return joined.orderBy(F.desc(F.col("status") == "open"), F.desc("created_at"), "report_id").limit(rows)


def rating_summary(ratings: DataFrame) -> DataFrame:
    """One row: n, mean (two digits; null of none) and stars, the counts of 1 to 5."""
    stars = F.array(*(F.count_if(F.col("rating") == i) for i in range(1, 6)))
    return ratings.agg(F.count("*").alias("n"), F.round(F.avg("rating"), 2).alias("mean"), stars.alias("stars"))


def latest_reviews(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """ratings(user_id, created_at, modified_at, …) of users that exist, with their email, the latest first."""
    joined = ratings.join(users.select("user_id", "email"), "user_id")
    return joined.orderBy(F.desc(F.coalesce("modified_at", "created_at")), "user_id")


def journal(deposits: DataFrame, rows: int = JOURNAL_ROWS) -> DataFrame:
    """The last validated deposits(deposit_id, status, decided_at, diff) with counts by status and a few highlights."""
    n = lambda s: F.size(F.filter("diff", lambda d: d["status"] == s)).alias(s)
    told = F.slice(F.filter("diff", lambda d: (d["status"] == "changed") & (F.coalesce(d["summary"], F.lit("")) != "")), 1, HIGHLIGHTS)
    kept = deposits.where("status = 'valid'").orderBy(F.desc("decided_at"), "deposit_id").limit(rows)
    return kept.select("deposit_id", "decided_at", n("added"), n("changed"), n("repealed"), told.alias("highlights"))


def size_summary(articles: DataFrame) -> DataFrame:
    """text_id, n, shortest, longest and the upper median of content lengths."""
    # by length, so that a text with very many articles is a few rows; nulls count as articles, but have no length
    counts = articles.groupBy("text_id", F.length("content").alias("length")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("text_id").orderBy("length")
    known = F.sum(F.when(F.col("length").isNotNull(), F.col("n")))
    ranked = counts.withColumns({"upto": known.over(by), "all": F.sum("n").over(Window.partitionBy("text_id"))})
    median = F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("length")))
    return ranked.groupBy("text_id").agg(F.sum("n").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), median.alias("median"))


def text_spans(articles: DataFrame) -> DataFrame:
    """text_id, n, the first and last number (by id) and the first and last page of articles(text_id, id, number, page); page 0
    is none."""
    return articles.groupBy("text_id").agg(F.count("*").alias("n"), F.min_by("number", "id").alias("first_number"), F.max_by("number", "id").alias("last_number"), F.min(F.when(F.col("page") > 0, F.col("page"))).alias("first_page"), F.max(F.when(F.col("page") > 0, F.col("page"))).alias("last_page"))


def sampled(articles: DataFrame, size: int, seed: int) -> DataFrame:
    """A reproducible sample of each text: its first and last article, and others in the order of a hash.

    Every task hands on no more than `size` articles of a text, and its first and last."""
    ends = articles.groupBy("text_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("text_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    hashed = Window.partitionBy("text_id").orderBy(F.xxhash64(F.lit(seed), F.col("id")))
    least = articles.select("text_id", "id").withColumn("__r", F.row_number().over(hashed)).where(F.col("__r") <= size).select("text_id", "id")
    both = ends.withColumn("__end", F.lit(1)).unionByName(least.withColumn("__end", F.lit(0))).groupBy("text_id", "id").agg(F.max("__end").alias("__end"))
    order = Window.partitionBy("text_id").orderBy(F.desc("__end"), F.xxhash64(F.lit(seed), F.col("id")))
    chosen = both.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).select("text_id", "id")
    return articles.join(chosen, ["text_id", "id"], "left_semi").select(*articles.columns).orderBy("text_id", "id")


def versions_cited(citations: DataFrame, articles: DataFrame, texts: DataFrame) -> DataFrame:
    """message_id and versions: the distinct versions of the texts that a message cites, sorted."""
    joined = citations.join(articles.select(F.col("id").alias("article_id"), "text_id"), "article_id").join(texts.select(F.col("id").alias("text_id"), "acronym", "dated"), "text_id")
    shown = F.concat("acronym", F.lit(" ("), F.date_format("dated", "dd/MM/yyyy"), F.lit(")"))
    return joined.groupBy("message_id").agg(F.sort_array(F.collect_set(shown)).alias("versions"))


def without_version(articles: DataFrame, deposits: DataFrame, texts: DataFrame, text_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """articles, deposits and texts after a failed version is taken out; its deposits stay, detached."""
    gone = F.col("text_id") == text_id
    return articles.where(~gone), deposits.withColumn("text_id", F.when(~gone, F.col("text_id"))), texts.where(F.col("id") != text_id)


def repaired_paths(articles: DataFrame, fixed: DataFrame) -> DataFrame:
    """articles with the paths of fixed(text_id, number, path, source_sha256) where these differ and the source is the same;
    a changed path takes the vector away, which was made from it."""
    new = fixed.select("text_id", "number", F.col("path").alias("__path"), F.col("source_sha256").alias("__sha"))
    joined = articles.join(new, ["text_id", "number"], "left")
    change = F.col("__path").isNotNull() & (F.col("__sha") == F.col("source_sha256")) & ~F.col("path").eqNullSafe(F.col("__path"))
    change = F.coalesce(change, F.lit(False))
    altered = {"path": F.when(change, F.col("__path")).otherwise(F.col("path")), "embedding": F.when(~change, F.col("embedding"))}
    return joined.select(*(altered.get(c, F.col(c)).alias(c) for c in articles.columns))
