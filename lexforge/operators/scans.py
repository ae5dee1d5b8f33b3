"""Running values along ordered rows of a key, however many rows one key has.

Rows of a key are cut into blocks. A block says what it ends with, these few summaries are read in order, and every
block then starts from what stands before it; only blocks, never whole keys, are one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, block: Column) -> DataFrame:
    """rows with block, which must not fall along a key's order, dealt out by key and block."""
    return rows.withColumn("block", block).repartition(key, "block")


def scanned(rows: DataFrame, key: str, order: str, last: dict[str, Column] | None = None, count: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """rows of `in_blocks`, ordered by a column that no two rows of a key share, with under each name of last: the last value
    up to a row that is not null; of previous: that before the row; of following: the first behind it; of count: how many
    values up to a row are not null. Rows without a key are read, but block by block."""
    last, count, previous, following = last or {}, count or {}, previous or {}, following or {}
    held = rows.withColumns(last | count | previous | following)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = held.groupBy(key, "block").agg(*(F.max_by(c, known(c)).alias(c) for c in [*last, *previous]), *(F.min_by(c, known(c)).alias(c) for c in following), *(F.count(c).alias(c) for c in count))
    # frames that reach back are one pass; so what follows is read in descending order
    back = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before, behind = back(key).orderBy("block"), back(key).orderBy(F.desc("block"))
    carried = [F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in [*last, *previous]] + [F.last(c, ignorenulls=True).over(behind).alias(f"__{c}") for c in following]
    starts = ends.select(key, "block", *carried, *(F.sum(c).over(before).alias(f"__{c}") for c in count))
    so_far = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier, later = back(key, "block").orderBy(order), back(key, "block").orderBy(F.desc(order))
    within = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__{c}")) for names, w in ((last, so_far), (previous, earlier), (following, later)) for c in names}
    within |= {c: F.coalesce(F.col(f"__{c}"), F.lit(0)) + F.count(c).over(so_far) for c in count}
    return held.join(starts, [key, "block"], "left").withColumns(within).drop(*(f"__{c}" for c in within))


def ranges(rows: DataFrame, column: str, parts: int) -> Column:
    """The number of the range that a value of column falls into, of about `parts` ranges with about as many rows each."""
    limits = rows.approxQuantile(column, [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(limits)))), lambda x: x <= F.col(column))) if limits else F.lit(0)
