"""Sources: tables, paginated texts, question sets, provenance cards, page lists and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import paged_lines

QUESTIONS = "id int, question string, type string, articles_attendus array<string>, reponse_attendue string, doit_refuser boolean"
CHUNKS = "numero string, chemin string, contenu string, page_debut int"
CARD = "fichier string, sigle string, titre string, type string, version string, date_consolidation date, url_source string, telecharge_le date, sha256 string, taille_octets long, valide_par string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def paginated_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file), page_no, line_no and line of text files with page markers."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return paged_lines(whole)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set without its heading, which has no id."""
    return spark.read.schema(QUESTIONS).json(path, multiLine=True).where("id IS NOT NULL")


def article_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path, multiLine=True)


def provenance_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path, multiLine=True)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """folder, sha256 and bytes: of a file its content's digest; of a folder the digest of its files' digests in order."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x["digest"])
    return files.groupBy(folder.alias("folder")).agg(F.when(F.count("*") == 1, F.first("digest")).otherwise(F.sha2(F.array_join(ordered, ""), 256)).alias("sha256"), F.sum("length").alias("bytes"))


def listed_numbers(html: Column, pattern: str) -> Column:
    """The distinct whole numbers that a pattern's first group takes from a page, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))))


def page_numbers(ranges: Column) -> Column:
    """The page numbers of a list of ranges such as "0-9,12", sorted and distinct."""
    parts = F.filter(F.transform(F.split(ranges, ","), lambda p: F.trim(p)), lambda p: p != "")
    each = F.transform(parts, lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(each)))
