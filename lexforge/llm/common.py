"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Entries a per-task memo may hold before it is emptied, and characters of the longest entry; bound a worker's memory.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
#: Bytes of a batch that goes to Python (one row at least), where the session names no bound. Spark's own is 64 MB, of which
#: an executor holds several a task, outside its heap.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, lengthened until no column is called that."""
    names = {n.lower() for n in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound of a batch in bytes, unless one is set. It says how rows are handed on, not what becomes of them."""
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


#: What tasks that follow one another in this worker share; one thing at a time.
_REMEMBERED: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    _REMEMBERED.clear()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, remembers: bool = False) -> DataFrame:
    """mapInArrow with a function made once per task. Unless it remembers something for the tasks that follow, the worker
    lets go of what others remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        one = make()
        for batch in batches:
            yield one(batch)

    return df.mapInArrow(run, schema)
