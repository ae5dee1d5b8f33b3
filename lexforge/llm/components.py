"""Connected components of a link table, and tables kept between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes that a task's forest holds before it is given out, and edges that a task is given, which have no more nodes.
NODES = 500_000
EDGES = NODES // 2


def kept_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Only where one machine runs everything (a local
    master) and the session names none, a temporary one is set; elsewhere that is an error, as executors share no folder."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tables-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, bag: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder, and read again. That cuts the lineage, survives the loss of executors,
    and lets several jobs read it. bag: takes the table's path, for `discard`."""
    path = f"{kept_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if bag is not None:
        bag.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, bag: list[str]) -> None:
    """Remove the tables of bag, which nothing reads any more."""
    jvm = spark._jvm
    for path in bag:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    bag.clear()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the nodes of a task's links to the smallest node they reach in them, NODES nodes at a time."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    def hung() -> pa.RecordBatch:
        pairs = [(x, y) for x in list(above) if (y := top(x)) != x]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
        if len(above) > NODES:
            yield hung()
    yield hung()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges(u, v), u > v, has one v, which itself is nobody's u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return seen.where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected_components(links: DataFrame, bag: list[str] | None = None) -> DataFrame:
    """node and component (its smallest node) of every node of links(a, b), by alternating large and small stars, until
    only stars are left. Null ends are no links. bag: takes the path of the result's table.

    Each round first gives tasks EDGES edges each, of which they hang what they see of a component on its smallest node;
    where one task does for all edges, that leaves stars. Otherwise it hangs the neighbours of every node on the smallest
    of them. A node with very many neighbours only takes part in a minimum and an equality join, both of which Spark splits."""
    spark, old = links.sparkSession, []

    def next_(edges: DataFrame) -> DataFrame:
        new: list[str] = []
        kept = stored(edges, new)
        discard(spark, old)
        old.extend(new)
        return kept

    edges = next_(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct())
    while (tasks := -(-edges.count() // EDGES)) > 1 and not _are_stars(edges):
        edges = next_(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long").distinct())
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = next_(small.select("e.u", "e.v").where("u <> v").distinct())
    if tasks == 1:
        edges = next_(edges.coalesce(1).mapInArrow(_forest, "u long, v long"))
    if bag is not None:
        bag += old
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
