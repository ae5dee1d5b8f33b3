"""URL filters by a temporal list join.

Dated list entries (list_name, key, action, at) become validity intervals: an entry holds from its date
until the next entry of the same list and key, and a "remove" only ends what went before. A capture is
judged by the entries that held when it was fetched. A key is a domain, which covers its subdomains, or a
domain with a path prefix; the longest matching key decides, and "allow" goes before "block".

The as-of join is an equality join on key and month, within which intervals are compared, so that neither
a key with very many captures nor one with a long history is one task's work alone. Captures are reduced
to distinct (url, time) pairs first. Spark chooses to broadcast intervals only by their measured size.

A null or hostless url, and a null time, match nothing and are kept. Entries with a null key, action or
time are ignored; two entries at the same time: the one whose action sorts last holds. Empty tables are
fine. All columns of the captures are returned; the added ones replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def _numbered(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def candidate_keys(url: Column, depth: int) -> Column:
    """Keys that cover url: its domain and those above it of two labels or more, and its path prefixes of up to depth parts."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    above = F.transform(_numbered(F.when(host.rlike(r"^[0-9.]+$"), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")
    prefixes = F.transform(_numbered(F.least(F.size(parts), F.lit(depth))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.concat(above, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """list_name, key, action, valid_from and valid_to (null: still open) of the entries that are not removals."""
    known = entries.where(F.col("key").isNotNull() & F.col("action").isNotNull() & F.col("at").isNotNull())
    held = known.groupBy("list_name", "key", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "key").orderBy("at")
    dated = held.withColumn("valid_to", F.lead("at").over(order)).where(F.col("action") != "remove")
    return dated.select("list_name", "key", "action", F.col("at").alias("valid_from"), "valid_to")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched_at, ...) with decision ("keep" or "block"), matched_key and matched_list."""
    intervals = validity(entries)
    own = captures.drop("decision", "matched_key", "matched_list")
    bounds = own.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
    depth = intervals.agg(F.coalesce(F.max(F.size(F.split("key", "/"))) - 1, F.lit(0)).alias("depth")).first()["depth"]
    first, last = bounds.first()
    if first is None:
        return own.withColumns({"decision": F.lit("keep"), "matched_key": F.lit(None).cast("string"), "matched_list": F.lit(None).cast("string")})
    begin, end = F.greatest(F.col("valid_from"), F.lit(first)), F.coalesce(F.least(F.col("valid_to"), F.lit(last)), F.lit(last))
    monthly = intervals.where((begin <= end)).withColumn("month", F.explode(F.sequence(_month(begin), _month(end))))
    asked = own.where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).select("url", "fetched_at").distinct()
    keyed = asked.select("url", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(candidate_keys(F.col("url"), depth)).alias("key"))
    during = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    matches = keyed.join(monthly, ["key", "month"]).where(during)
    rank = F.struct(F.length("key").alias("n"), (F.col("action") == "allow").alias("allowed"), "key", "list_name", "action")
    best = matches.groupBy("url", "fetched_at").agg(F.max(rank).alias("best"))
    judged = best.select("url", "fetched_at", F.when(F.col("best.action") == "block", "block").otherwise("keep").alias("decision"), F.col("best.key").alias("matched_key"), F.col("best.list_name").alias("matched_list"))
    return own.join(judged, ["url", "fetched_at"], "left").withColumn("decision", F.coalesce("decision", F.lit("keep")))
