"""Sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.documents import assembled_text


def append_articles(articles: DataFrame, path: str) -> None:
    """Append articles with the words they are searched by."""
    articles.withColumn("tokens", tokens(F.col("content"))).write.mode("append").parquet(path)


def write_paginated(pages: DataFrame, path: str) -> None:
    """Texts with page markers, one Parquet row a document."""
    assembled_text(pages).write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").csv(path, header=True)


def reading_sheet(sample: DataFrame) -> DataFrame:
    """text_id, id and sheet: what a proof-reader is given for each sampled article."""
    sheet = F.concat_ws("\n", F.concat(F.lit("Article "), "number"), F.when(F.trim("path") != "", F.col("path")), F.col("content"), F.lit("[ ] conforming   [ ] to correct"))
    return sample.select("text_id", "id", sheet.alias("sheet"))


def _checked(df: DataFrame) -> list:
    """Counts that tell whether a table is the same, in whatever order its rows are."""
    h = F.xxhash64(*df.columns)
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("summed")]


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables as a new version below root, read each back, and only then turn the pointer file CURRENT to it, in one
    step; returns the version's name. A failure before that leaves the version that was there, whole."""
    spark, version = next(iter(tables.values())).sparkSession, f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        seen = Observation(f"{version}-{name}")
        df.observe(seen, *_checked(df)).write.parquet(f"{root}/{version}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}")
        if written.agg(*_checked(written)).first().asDict() != seen.get:
            raise OSError(f"{name} is not what was written")
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(jvm.java.net.URI.create(f"{root}/CURRENT"), spark._jsc.hadoopConfiguration()) if ":" in root else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    aside, pointer = fs.Path(f"{root}/{version}/pointer"), fs.Path(f"{root}/CURRENT")
    out = aside.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = getattr(fs, "Options$Rename").OVERWRITE
    how = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = overwrite
    context.rename(aside, pointer, how)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that the pointer file at root names."""
    (row,) = spark.read.text(f"{root}/CURRENT").collect()
    return spark.read.parquet(f"{root}/{row['value']}/{name}")
