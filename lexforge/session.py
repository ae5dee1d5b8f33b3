"""A session with the settings this library is meant for; a cluster's own settings go before these."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lexforge", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
