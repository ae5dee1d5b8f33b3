"""Rows whose fields contain a term, for many terms at once, by q-gram postings.

Every field is cut into its distinct grams of one to GRAM characters. A term is looked up by one of its own grams of the
greatest length, the one that the fewest fields hold, and only what that brings together is compared as strings. So a gram
that stands in every field, such as those of a common domain of e-mail addresses, is used by a term only if the term has
no other, and then every match of it is a result or nearly so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept

#: Characters of the longest grams, and fields of a gram that one task compares, about.
GRAM, BLOCK = 3, 20_000


def _grams(text: Column, sizes: range) -> Column:
    """The distinct grams of a text of each of sizes."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, sizes)))


def containing(rows: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame) -> DataFrame:
    """term and key of every row of which some field contains the term, once each. terms(term); null and empty terms are in
    none. fields: as they are to be compared; null ones contain nothing."""
    asked = terms.select("term").where("term <> ''").distinct()
    texts = rows.select(key, F.explode(F.array_distinct(F.array(*fields.values()))).alias("text")).where("text <> ''")
    keyed = asked.withColumn("gram", F.explode(_grams(F.col("term"), range(1, GRAM + 1)))).where(F.length("gram") == F.least(F.length("term"), F.lit(GRAM)))
    # only grams that some term has take part; so short, they are no more than the alphabet makes, and no field is dealt by them
    wanted = F.broadcast(keyed.select("gram").distinct())
    postings = texts.withColumn("gram", F.explode(_grams(F.col("text"), range(1, GRAM + 1)))).join(wanted, "gram", "left_semi")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no field has rules its term out
    rarest = keyed.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    fields, asked = _dealt(postings, kept(rarest.select("term", "g.gram", F.ceil(F.col("g.n") / BLOCK).cast("int").alias("blocks"))), key)
    return fields.join(asked, ["gram", "block"]).where(F.contains("text", "term")).select("term", key).distinct()


def _dealt(postings: DataFrame, rarest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both with block: the fields of a frequent gram are dealt out over its blocks, each of which meets all of its terms."""
    large = F.broadcast(rarest.where("blocks > 1").select("gram", "blocks").distinct())  # each has over BLOCK fields
    fields = postings.join(large, "gram", "left").withColumn("block", F.pmod(F.xxhash64(key, "text"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    return fields, rarest.select("term", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
