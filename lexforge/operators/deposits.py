"""Deposits awaiting review: what is refused on arrival, what is read first, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the largest file that is taken.
LARGEST_BYTES = 60 * 1024 * 1024


def arrival_problems(files: DataFrame, scanned: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and problem (null if taken) of files(doc_id, content): empty, too large, no PDF, scanned, or without articles."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("articles"))
    joined = files.join(scanned, "doc_id", "left").join(counted, "doc_id", "left")
    problem = F.when(F.length("content") == 0, "empty").when(F.length("content") > LARGEST_BYTES, "too_large").when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "no_pdf")
    return joined.select("doc_id", problem.when(F.coalesce("scanned", F.lit(False)), "scanned").when(F.col("articles").isNull(), "no_article").alias("problem"))


def version_conflicts(deposits: DataFrame, texts: DataFrame, citation_counts: DataFrame) -> DataFrame:
    """deposit_id, text_id and replaceable of deposits(deposit_id, acronym, version) whose version is there already: it may be
    replaced only while nothing cites it."""
    there = deposits.join(texts.select(F.col("id").alias("text_id"), "acronym", "version"), ["acronym", "version"])
    return there.join(citation_counts, "text_id", "left").select("deposit_id", "text_id", (F.coalesce("n", F.lit(0)) == 0).alias("replaceable"))


def review_queue(diff: DataFrame) -> DataFrame:
    """The changes of a deposit, the least similar first."""
    return diff.where("status <> 'unchanged'").orderBy("similarity", "number")


def with_reviewed(deposits: DataFrame, read: DataFrame) -> DataFrame:
    """deposits(deposit_id, reviewed, …) with the numbers of read(deposit_id, number) put to those reviewed before."""
    new = read.groupBy("deposit_id").agg(F.collect_set("number").alias("__new"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("reviewed", none), F.coalesce("__new", none)))
    return deposits.join(new, "deposit_id", "left").select(*(both.alias("reviewed") if c == "reviewed" else F.col(c) for c in deposits.columns))


def rejected(deposits: DataFrame, who: DataFrame, at: Column) -> DataFrame:
    """deposits(deposit_id, status, decided_by, decided_at, …) after those of who(deposit_id, actor) are rejected, unless they
    are valid already; their chunks stay."""
    joined = deposits.join(who.select("deposit_id", F.col("actor").alias("__actor")), "deposit_id", "left")
    done = F.col("__actor").isNotNull() & (F.col("status") != "valid")
    changed = {"status": F.when(done, "rejected"), "decided_by": F.when(done, F.col("__actor")), "decided_at": F.when(done, at)}
    return joined.select(*(F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in deposits.columns))


def found(rows: DataFrame, term: str, columns: list[str], exact: tuple[str, ...] = ("role", "plan")) -> DataFrame:
    """Rows of which some column contains a term; case counts only in the columns named as exact."""
    tests = [F.coalesce(F.col(c) if c in exact else F.lower(c), F.lit("")).contains(term.strip().lower()) for c in columns]
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return rows.where(test)


#: Chunks of a deposit that are numbered together.
PLACES = 10_000


def _counted_on(rows: DataFrame, group: str, place: Column, order: str, first: Column, name: str) -> DataFrame:
    """rows with name: numbers from first + 1 on, by group and then order. place: blocks along a group's order, which are ranked
    by themselves; only how many rows each has is read in one task."""
    blocks = rows.withColumn("__block", place)
    within = Window.partitionBy(group, "__block").orderBy(order)
    before = Window.orderBy(group, "__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    starts = sizes.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = blocks.withColumn("__within", F.row_number().over(within)).join(starts, [group, "__block"])
    return ranked.withColumn(name, (first + F.col("__before") + F.col("__within")).cast("long")).drop("__block", "__before", "__within")


def validation_outcomes(deposits: DataFrame, problems: DataFrame, analysis: DataFrame, who: DataFrame) -> DataFrame:
    """deposit_id, actor and outcome for each of who(deposit_id, actor), one row a deposit: "unknown", "not_pending", "blocked" by
    some of problems(deposit_id, level), "unreviewed", if some number of analysis(deposit_id, number, status) that is not
    unchanged is not among those reviewed, or "valid". A deposit without an analysis needs no review."""
    asked = who.groupBy("deposit_id").agg(F.min("actor").alias("actor"))
    blocked = problems.where("level = 'blocking'").select("deposit_id").distinct().withColumn("blocked", F.lit(True))
    changed = analysis.where("status <> 'unchanged'").select("deposit_id", "number").distinct()
    read = deposits.select("deposit_id", F.explode(F.coalesce("reviewed", F.array().cast("array<string>"))).alias("number"))
    missing = changed.join(read, ["deposit_id", "number"], "left_anti").select("deposit_id").distinct().withColumn("missing", F.lit(True))
    joined = asked.join(deposits.select("deposit_id", "status"), "deposit_id", "left").join(blocked, "deposit_id", "left").join(missing, "deposit_id", "left")
    outcome = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "pending", "not_pending").when(F.col("blocked"), "blocked").when(F.col("missing"), "unreviewed").otherwise("valid")
    return joined.select("deposit_id", "actor", outcome.alias("outcome"))


def validated(deposits: DataFrame, chunks: DataFrame, texts: DataFrame, articles: DataFrame, outcomes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts(id, acronym, version, dated), articles(id, text_id, number, path, content, effective_on, repealed_on) and deposits
    after those with the outcome "valid" have entered the corpus, in the order of their ids.

    Each becomes a text with the next id, and its chunks(deposit_id, seq, number, path, content) become its articles, with the
    next ids, in force from its date. On that date the articles in force of every other text of its acronym end, those of
    deposits validated just before among them. Nothing is overwritten; where no deposit is valid, nothing changes."""
    chosen = deposits.join(outcomes.where("outcome = 'valid'").select("deposit_id", "actor"), "deposit_id")
    last = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # noqa: E731  one row
    grouped = chosen.withColumn("__all", F.lit(0)).crossJoin(F.broadcast(last(texts)))
    named = _counted_on(grouped, "__all", F.floor(F.col("deposit_id") / PLACES), "deposit_id", F.col("__last"), "new_id").drop("__all", "__last")
    named = named.withColumn("ends", F.lead("dated").over(Window.partitionBy("acronym").orderBy("deposit_id")))
    new_texts = named.select(F.col("new_id").alias("id"), "acronym", "version", "dated")
    held = chunks.join(named.select("deposit_id", "new_id", "dated", "ends"), "deposit_id").crossJoin(F.broadcast(last(articles)))
    numbered = _counted_on(held, "deposit_id", F.floor(F.col("seq") / PLACES), "seq", F.col("__last"), "id")
    new_articles = numbered.select("id", F.col("new_id").alias("text_id"), "number", "path", "content", F.col("dated").alias("effective_on"), F.col("ends").alias("repealed_on"))
    first = named.groupBy("acronym").agg(F.min_by("dated", "deposit_id").alias("__on"))
    closing = texts.join(first, "acronym").select(F.col("id").alias("text_id"), "__on")
    closed = articles.join(closing, "text_id", "left").withColumn("repealed_on", F.coalesce("repealed_on", "__on"))
    decided = {"status": F.when(F.col("__text").isNotNull(), "valid"), "decided_by": F.col("__actor"), "decided_at": F.when(F.col("__text").isNotNull(), at), "text_id": F.col("__text")}
    marked = deposits.join(named.select("deposit_id", F.col("actor").alias("__actor"), F.col("new_id").alias("__text")), "deposit_id", "left")
    after = marked.select(*(F.coalesce(decided[c], F.col(c)).alias(c) if c in decided else F.col(c) for c in deposits.columns))
    return texts.select(*new_texts.columns).unionByName(new_texts), closed.select(*new_articles.columns).unionByName(new_articles), after
