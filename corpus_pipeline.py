"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, whatever further ones
there are. Empty tables give no rows. Texts go to Python in batches bounded by bytes, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontamination, language_id, near_duplicates, piece_codec, substring_dedup
from lexforge.llm.common import bound_batches, table
from lexforge.llm.components import stored


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, or in which no language is likelier than all others
    together, go. Each row is judged by its own text, so rows that share an id, or have none, are judged apart."""
    return language_id.keep_determined(docs, language_id.train(docs, _pieces()))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Rows with the same id are one document, and
    stay or go together; rows without an id go where their group has one, else one of them stays. Texts without words stay."""
    bound_batches(spark)
    return near_duplicates.first_of_each(docs).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of strings of 100 bytes that stand earlier too, in the order of ids; documents stay. Rows with the
    same id are one document; rows without an id, and null texts, lose nothing."""
    bound_batches(spark)
    return substring_dedup.remove_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its budget of edits, go. Each row is judged by its own text; null and empty
    texts stay."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of pieces, and digests of ids, spans and decoded text, of every row that is left; a null text is empty."""
    bound_batches(spark)
    return piece_codec.encode_digests(docs, _pieces()).drop("decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("piece_codec", encode_pieces),
]

#: No stage can be expressed in SQL; the whole is tested against a brute-force version, as is each operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
