"""Exact top-k inner-product search by distributed histogram selection.

Vectors are packed into blocks, and every block of queries meets every block of vectors once a pass.
A pass counts each query's scores in equal bins of its current range; the bin that holds the k-th
highest becomes the next range, until a bin is one score wide. A last pass keeps the scores at or above
that k-th value, and ties go to the smaller id. Nothing is sampled and no candidate list is capped
before the k-th value is known.

Vectors that are null, or hold null or non-finite components, and rows without an id, take no part. Vectors
of different lengths are never compared. A query with fewer than k candidates gets all of them. Empty tables
give no rows. A row that stands twice counts as two candidates, but as one query; an id with several different
vectors is several queries, none of which has a row of that id as a candidate. Scores must fit 64 bits, their
terms need not; a component or a score that does not fit, or is too near the limit to tell, is an error. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored

BINS = 4096
#: Vectors of a block, and queries of one, at most; and the bytes of their components, but for single vectors that are longer.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 4096, 512, 1 << 22
#: Query blocks whose histograms a task holds at a time, 16 MB each.
HELD = 8
#: Vectors of a group of blocks, about: query blocks are copied to each group, which is the work of one task or of a few.
GROUP = 32 * BLOCK

#: bytes: of a component.
_BLOCK_SCHEMA = "dim int, part long, n int, bytes int, ids binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and the vector floor(scale * x) of the rows that take part. A component beyond 64 bits is an error."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    whole = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    return used.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: whole(scale * x.cast("double"))).alias("vector"))


def _narrow(values: np.ndarray) -> int:
    """Bytes that hold each of values."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return next(n for n in (2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            dims = np.diff(offsets)
            rows: list[tuple] = []
            for dim in np.unique(dims).tolist():
                where = np.flatnonzero(dims == dim)
                step = max(1, min(size, BLOCK_BYTES // max(8 * dim, 1)))
                for at in range(0, len(where), step):
                    chosen = where[at : at + step]
                    vectors = values[(offsets[chosen][:, None] + np.arange(dim)).ravel()]
                    n = _narrow(vectors)
                    rows.append((dim, int(ids[chosen[0]]), len(chosen), n, ids[chosen].astype("<i8").tobytes(), vectors.astype(f"<i{n}").tobytes()))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["dim", "part", "n", "bytes", "ids", "vectors"])

    return run


def _pairs(queries: DataFrame, blocks: DataFrame, states: DataFrame, groups: int) -> DataFrame:
    """Every block of queries beside every block of vectors of its dimension, in any order: pairs are made one at a time and
    never kept."""
    q = queries.join(states, "q_part").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = blocks.select("dim", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("group"), F.col("bytes").alias("b_bytes"), F.col("ids").alias("b_ids"), F.col("vectors").alias("b_vectors"))
    return q.join(b, ["dim", "group"])


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids, scores, and which pairs are a row with itself."""
    q_ids, b_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["b_ids"], "<i8")
    q, b = (np.frombuffer(row[f"{k}_vectors"], f"<i{row[f'{k}_bytes']}").astype(np.int64).reshape(len(i), row["dim"]) for k, i in (("q", q_ids), ("b", b_ids)))
    top = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * max(row["dim"], 1)
    own = q_ids[:, None] == b_ids[None, :]
    # whole numbers below 2 ** 53 are exact in floating point, where the product is fast
    near = q.astype(float) @ b.T.astype(float)
    if top < 1 << 53:
        return q_ids, b_ids, near.astype(np.int64), own
    # sums of 64 bits wrap around and come out right if the result fits, which the rounded product tells up to its error
    error = (np.abs(q.astype(float)) @ np.abs(b.T.astype(float))) * (row["dim"] + 2) * 2.0**-52
    if ((np.abs(near) + error >= 2.0**63) & ~own).any():
        raise OverflowError("a score does not fit 64 bits")
    return q_ids, b_ids, q @ b.T, own


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _histograms(k: int):
    """Per query, the counts of its highest bins of the current range until k are counted, over blocks of a task: over all of
    them if the task sees few blocks of queries or sees each at a stretch, as joins give them. A bin that is left out has k
    scores above it in these blocks alone."""

    def flush(part: int, counts: np.ndarray) -> pa.RecordBatch:
        after = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in higher bins
        row, bin_ = np.nonzero((counts > 0) & (after < k))
        arrays = [pa.array(np.full(len(row), part)), pa.array(row.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[row, bin_])]
        return pa.RecordBatch.from_arrays(arrays, ["q_part", "q_row", "bin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            ids, _, scores, own = _scores(row)
            if (counts := held.pop(row["q_part"], None)) is None:
                if len(held) == HELD:
                    part = next(iter(held))
                    yield flush(part, held.pop(part))
                counts = np.zeros((len(ids), BINS), np.int64)
            held[row["q_part"]] = counts  # the latest stands last
            low = np.array(row["low"], np.int64)[:, None]
            # a difference of two numbers of 64 bits fits 64 bits without a sign
            bins = (scores.view(np.uint64) - low.view(np.uint64)) // np.uint64(row["width"])
            kept = (scores >= low) & (bins < BINS) & ~own
            bins = np.where(kept, bins, 0).astype(np.int64)
            flat = (np.arange(len(ids))[:, None] * BINS + bins)[kept]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        for part, counts in held.items():
            yield flush(part, counts)

    return run


def _selected(k: int):
    """Per query, a task's best k by score and then smaller id, of the scores at or above its k-th value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, b_ids, scores, own = _scores(row)
            at, by = np.nonzero((scores >= np.array(row["low"], np.int64)[:, None]) & ~own)
            value, ids = scores[at, by], b_ids[by]
            order = np.lexsort((ids, -value, at))
            at, value, ids = at[order], value[order], ids[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            best = rank < k
            part = pa.array(np.full(int(best.sum()), row["q_part"], np.int64))
            yield pa.RecordBatch.from_arrays([part, pa.array(at[best].astype(np.int32)), pa.array(q_ids[at[best]]), pa.array(ids[best]), pa.array(value[best])], ["q_part", "q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of vectors(vec_id, vector of long) with is_query."""
    blocks = vectors.mapInArrow(_pack(BLOCK), _BLOCK_SCHEMA)
    asked = vectors.where(is_query).select("vec_id", "vector").distinct()
    largest = vectors.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(38,0)"))))).alias("x"), F.max(F.size("vector")).alias("d"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    groups = max(8, -(-largest["n"] // GROUP))
    queries = asked.repartition(max(1, -(-largest["q"] // (8 * QUERY_BLOCK))), "vec_id").mapInArrow(_pack(QUERY_BLOCK), _BLOCK_SCHEMA)
    # written once: another evaluation may pack other rows together, and passes know a query by its block and place
    queries = stored(queries.select("dim", F.monotonically_increasing_id().alias("q_part"), F.col("n").alias("q_n"), F.col("bytes").alias("q_bytes"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    # scores beyond 64 bits are errors, so the first range ends there
    bound = min(int(largest["x"] or 0) ** 2 * (largest["d"] or 0) + 1, (1 << 63) - 1)
    widths = [1]
    while widths[0] * BINS < 2 * bound + 1:
        widths.insert(0, widths[0] * BINS)
    states = queries.select("q_part", F.array_repeat(F.lit(-bound).cast("long"), F.col("q_n")).alias("low"), F.array_repeat(F.lit(k).cast("long"), F.col("q_n")).alias("need"))
    for width in widths:
        # need: how many of the k are still to be found at or below the top of the range
        pairs = _pairs(queries, blocks, states, groups).withColumn("width", F.lit(width))
        counted = pairs.mapInArrow(_histograms(k), "q_part long, q_row int, bin int, n long").groupBy("q_part", "q_row", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("q_part", "q_row").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        # at least one bin; the last one where all bins together hold fewer than are needed
        chosen = counted.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        chosen = chosen.join(states.select("q_part", F.posexplode("need").alias("q_row", "need")), ["q_part", "q_row"]).where(F.col("above") < F.col("need"))
        chosen = chosen.groupBy("q_part", "q_row").agg(F.min_by(F.struct("bin", "above", "n"), "bin").alias("b"), F.first("need").alias("need"))
        chosen = chosen.withColumn("short", F.col("b.above") + F.col("b.n") < F.col("need"))
        found = chosen.groupBy("q_part").agg(F.map_from_entries(F.collect_list(F.struct("q_row", F.struct(F.when(~F.col("short"), F.col("b.bin")).alias("bin"), F.col("b.above").alias("above"))))).alias("found"))
        # a query with too few candidates keeps the bottom of its range
        # written each pass, as the next one reads it twice
        states = states.join(found, "q_part", "left").select(
            "q_part",
            F.transform("low", lambda low, i: (low.cast("decimal(20,0)") + F.lit(width).cast("decimal(20,0)") * F.coalesce(F.col("found")[i]["bin"], F.lit(0)).cast("decimal(5,0)")).cast("long")).alias("low"),
            F.transform("need", lambda need, i: need - F.when(F.col("found")[i]["bin"].isNotNull(), F.col("found")[i]["above"]).otherwise(0)).alias("need"),
        )
        states = stored(states)
    best = _pairs(queries, blocks, states, groups).mapInArrow(_selected(k), "q_part long, q_row int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_part", "q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
