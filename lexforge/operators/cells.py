"""A stored index of vectors in cells, for searches that need not be exact.

Cells are fitted on a sample of at most SAMPLE vectors, those whose ids' hashes are smallest; every vector, of the sample or
not, is then put into the cell of its nearest centre, and vectors that are added later into the same cells. Files are laid
out by cell. A search reads the cells whose centres are nearest to a question, `probes` of them; with as many as there are it
is exact. `retrieval.vector_candidates` stays the exact search that nothing has to be stored for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that cells are fitted on, at most, and rows of a cell's file, about.
SAMPLE, ROWS = 20_000, 200_000


def _usable(vectors: DataFrame) -> DataFrame:
    """id and unit, at length one in double, of vectors(id, embedding) that are neither null nor zero and are finite."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
    made = vectors.select("id", whole.alias("unit"), length.alias("__length")).where((F.col("__length") > 0) & (F.col("__length") < float("inf")))
    return made.select("id", F.transform("unit", lambda x: x / F.col("__length")).alias("unit"))


def _nearest(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """vectors(…, unit) with cell and turn, a row for each of the n nearest centres of a vector, of which that is the turn-th;
    vectors of another length get none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # as many as `build` was given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit")
            batch = batch.filter(pa.array(np.diff(np.asarray(units.offsets)) == shared.value.shape[1]))
            own = np.asarray(batch.column("unit").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            order = np.argsort(-(own @ shared.value.T), axis=1, kind="stable")[:, :n]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in batch.schema.names), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), batch.num_rows))], [*batch.schema.names, "cell", "turn"])

    schema = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, cell int, turn int")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])


def build(vectors: DataFrame, path: str, cells: int, seed: int = 1) -> None:
    """Write an index of vectors(id, embedding), all of one length, at path."""
    usable = _usable(vectors)
    sample = usable.orderBy(F.xxhash64("id")).limit(SAMPLE)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample.select(array_to_vector("unit").alias("features")))
    spark = vectors.sparkSession
    rows = [(i, (c / np.linalg.norm(c)).tolist()) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    add(vectors, path)


def add(vectors: DataFrame, path: str) -> None:
    """Put vectors(id, embedding), which must be new to it, into the index at path."""
    placed = _nearest(_usable(vectors), _centres(vectors.sparkSession, path), 1).drop("turn")
    n = vectors.count()
    parts = max(1, -(-n // ROWS))  # a crowded cell is several files
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def probes_for(path: str, questions: DataFrame, exact: DataFrame, recall: float = 0.95) -> int:
    """The fewest probes with which a search of the index finds at least that share of exact(question_id, id), the true
    neighbours of questions(question_id, vector): measured, not estimated. Questions are a bounded sample of those to come."""
    spark = questions.sparkSession
    centres = _centres(spark, path)
    asked = _nearest(_usable(questions.select(F.col("question_id").alias("id"), F.col("vector").alias("embedding"))), centres, len(centres))
    found = exact.join(spark.read.parquet(f"{path}/vectors").select("id", "cell"), "id").join(asked.select(F.col("id").alias("question_id"), "cell", "turn"), ["question_id", "cell"])
    counts = {r["turn"]: r["n"] for r in found.groupBy("turn").agg(F.count("*").alias("n")).collect()}  # a row a cell
    reached, total = 0, exact.count()
    for probes in range(1, len(centres) + 1):
        reached += counts.get(probes, 0)
        if reached >= recall * total:
            return probes
    return len(centres)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("unit", "asked")) if batch.num_rows else (np.zeros((0, 1)),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("question_id"), batch.column("id"), pa.array(np.einsum("ij,ij->i", a, b))], ["question_id", "id", "score"])


def search(path: str, questions: DataFrame, k: int, probes: int) -> DataFrame:
    """question_id, id, score (cosine) and rank of the k nearest vectors to each of questions(question_id, vector) in the
    `probes` cells nearest to it, ties to the smaller id."""
    spark = questions.sparkSession
    asked = _usable(questions.select(F.col("question_id").alias("id"), F.col("vector").alias("embedding")))
    wanted = _nearest(asked, _centres(spark, path), probes).select(F.col("id").alias("question_id"), F.col("unit").alias("asked"), "cell")
    met = spark.read.parquet(f"{path}/vectors").join(wanted, "cell").select("question_id", "id", "unit", "asked")
    kinds = dict(met.dtypes)
    scored = met.mapInArrow(_products, f"question_id {kinds['question_id']}, id {kinds['id']}, score double").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
