"""Vector and lexical candidates, their fusion, and the gates around them.

Everything works on many questions at once: a question_id partitions every ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from . import lexical

# Sizes and thresholds of retrieval.
CANDIDATES, RRF_K, RESULTS, LEAST_COVERAGE, LEAST_RELEVANCE = 20, 60, 8, 0.90, 0.55
REWRITE_BOUNDS, EXPANSION_BOUNDS, EXCERPT = (8, 4, 60), (8, 10, 40), 300


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where either is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _best(scored: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(vector: Column) -> Column:
    """A vector at length one; null if it is null or zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length))


def _of_acronym(articles: DataFrame, acronym: str | None) -> DataFrame:
    return articles if acronym is None else articles.where(F.col("acronym") == acronym)


#: Bytes of questions' vectors that meet the articles in one pass, and scores that a task holds at once.
QUESTION_BYTES, SCORES = 64 << 20, 1 << 22


class _Best:
    """The k best articles so far of every question of one length, ties to the smaller id."""

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k = matrix, k
        self.scores, self.ids = np.full((len(matrix), k), -np.inf), np.full((len(matrix), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, units: np.ndarray) -> None:
        step = max(1, SCORES // max(len(self.matrix), 1))
        for at in range(0, len(ids), step):
            scores = self.matrix @ units[at : at + step].T
            scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)  # to six digits, half up
            both = np.concatenate([self.scores, scores], axis=1)
            own = np.concatenate([self.ids, np.broadcast_to(ids[at : at + step], scores.shape)], axis=1)
            order = np.lexsort((own, -both), axis=1)[:, : self.k]
            self.scores, self.ids = np.take_along_axis(both, order, axis=1), np.take_along_axis(own, order, axis=1)


def _met(block: Broadcast, k: int):
    """mapInArrow: a task's best articles for each question of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {matrix.shape[1]: (ids, _Best(matrix, k)) for ids, matrix in block.value}
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            dims = np.diff(offsets)
            for dim in best.keys() & set(dims.tolist()):
                rows = np.flatnonzero(dims == dim)
                best[dim][1].meet(ids[rows], values[(offsets[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim))
        for asked, found in best.values():
            row, place = np.nonzero(found.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), pa.array(found.ids[row, place]), pa.array(found.scores[row, place])], ["question_id", "id", "score"])

    return run


def vector_candidates(articles: DataFrame, questions: DataFrame, k: int = CANDIDATES, acronym: str | None = None) -> DataFrame:
    """question_id, id, score and rank of the k articles(id, embedding) nearest to each of questions(question_id, vector);
    acronym: only articles of that one.

    Questions are a stated set. Their vectors go to the tasks in blocks of at most QUESTION_BYTES, each of which is one pass
    over the articles: a matrix product for every batch of them, of which a task keeps the k best of each question. So what is
    broadcast has a bound, nothing is shuffled but results, and no pair of an article and a question is ever a row."""
    unit = lambda df, key, vector: df.select(key, _unit(F.col(vector)).alias("unit")).where(F.col("unit").isNotNull())
    usable = unit(_of_acronym(articles, acronym).withColumn("id", F.col("id").cast("long")), "id", "embedding")
    asked = unit(questions, "question_id", "vector")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("unit")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-2 * size // QUESTION_BYTES)) if size > QUESTION_BYTES else 1
    schema, passes = f"question_id {dict(asked.dtypes)['question_id']}, id long, score double", []
    for number in range(blocks):
        held = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id", "unit"), F.lit(blocks)) == number)
        table = held.toArrow()
        dims = np.asarray(pc.list_value_length(table["unit"]))
        parts = [(table.filter(pa.array(dims == dim))) for dim in np.unique(dims).tolist() if dim]
        block = [(t["question_id"].combine_chunks(), np.array(t["unit"].combine_chunks().flatten()).reshape(len(t), -1)) for t in parts]
        passes.append(usable.mapInArrow(_met(usable.sparkSession.sparkContext.broadcast(block), k), schema))
    return _best(reduce(DataFrame.unionAll, passes), "score", k)


def lexical_candidates(articles: DataFrame, questions: DataFrame, k: int = CANDIDATES, acronym: str | None = None) -> DataFrame:
    """question_id, id, score and rank of the k articles(id, content) that share most terms with questions(question_id,
    question): the number of distinct terms of the question that stand in the article, then the share of its words that they
    are; acronym: only articles of that one."""
    return lexical.search_articles(_of_acronym(articles, acronym), questions, k).drop("matched")


def _fused(vectors: DataFrame, words: DataFrame, k: int, n: int) -> DataFrame:
    a = vectors.select("question_id", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = words.select("question_id", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, ["question_id", "id"], "full_outer").withColumn("rrf", F.round(share("vector_rank") + share("lexical_rank"), 9))
    order = Window.partitionBy("question_id").orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"), "id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("vector_score", "lexical_score")})


def fuse(vectors: DataFrame, words: DataFrame, k: int = RRF_K, n: int = RESULTS) -> DataFrame:
    """Reciprocal-rank fusion: question_id, id, vector_score, lexical_score, rrf and rank of the n best of both lists."""
    return _fused(vectors, words, k, n).select("question_id", "id", "vector_score", "lexical_score", "rrf", "rank")


def coverage(articles: DataFrame) -> DataFrame:
    """One row: the share of articles that have a vector, 0 of none."""
    return articles.agg(F.coalesce(F.try_divide(F.count("embedding"), F.count("*")), F.lit(0.0)).alias("coverage"))


def hybrid_search(articles: DataFrame, questions: DataFrame, least_coverage: float = LEAST_COVERAGE, texts: DataFrame | None = None) -> DataFrame:
    """Results of `fuse` with mode "hybrid" or "lexical_only". The vector list is dropped while too few articles have
    vectors; a question whose vector list is empty is lexical only; a blank question has no results. texts(id, content): the
    articles' contents where they stand apart from the vectors, so that no join moves them."""
    asked = questions.where(F.trim("question") != "")
    enough = coverage(articles)  # one row
    vectors = vector_candidates(articles, asked).join(F.broadcast(enough)).where(F.col("coverage") >= least_coverage).drop("coverage")
    fused = _fused(vectors, lexical_candidates(articles if texts is None else texts, asked), RRF_K, RESULTS)
    # the first of a vector list is always among the results, so these tell whether there is a list
    listed = F.max(F.col("vector_rank").isNotNull()).over(Window.partitionBy("question_id"))
    return fused.select("question_id", "id", "vector_score", "lexical_score", "rrf", "rank", F.when(listed, "hybrid").otherwise("lexical_only").alias("mode"))


def public_search(articles: DataFrame, questions: DataFrame, limit: int = 20, acronym: str | None = None) -> DataFrame:
    """question_id, id, score, rank and excerpt of the lexical results for anyone; limit: from 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("the limit must be from 1 to 100")
    best = lexical_candidates(articles, questions, limit, acronym)
    return best.join(articles.select("id", excerpt(F.col("content"), EXCERPT).alias("excerpt")), "id")


def relevance(results: DataFrame) -> DataFrame:
    """question_id and relevance: the largest cosine among its results."""
    return results.groupBy("question_id").agg(F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("relevance"))


def has_vectors(articles: DataFrame) -> bool:
    return not articles.where(F.col("embedding").isNotNull()).limit(1).isEmpty()


def guarded(candidate: Column, original: Column, bounds: tuple[int, int, int]) -> Column:
    """A provider's rewrite if its length is plausible for the original, else the original."""
    least, times, floor = bounds
    clean = F.trim(candidate)
    return F.when(F.length(clean).between(F.lit(least), times * F.greatest(F.length(original), F.lit(floor))), clean).otherwise(original)
