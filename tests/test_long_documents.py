import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import documents


def paginated(r, n):
    kinds = [
        lambda: f"===PAGE {r.randint(1, 40)}===", lambda: f"Article {r.randint(1, 99)} : {r.choice(['', 'début', 'x y'])}", lambda: f"TITRE {r.choice(['I', 'II', 'IV'])} - {r.choice(['des parts', ''])}",
        lambda: f"Chapitre {r.randint(1, 9)} : {r.choice(['de la forme', ''])}", lambda: f"Section {r.randint(1, 9)}", lambda: f"LIVRE {r.randint(1, 3)}", lambda: "un sommaire ........ 12",
    ]
    return "\n".join(r.choice(kinds)() if r.random() < 0.3 else r.choice(["une ligne de texte", "  ", "", "suite  du texte"]) for _ in range(n))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks_change_nothing(spark, monkeypatch, size):
    r = random.Random(size)
    texts = spark.createDataFrame([(i, paginated(r, r.randint(1, 120))) for i in range(60)] + [(90, ""), (91, None)], "doc_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(documents.articles(texts)), rows(documents.articles(texts, 5, 20)), rows(documents.paged_lines(texts))
    assert len(whole[0]) > 50 and whole[1]
    monkeypatch.setattr(documents, "BLOCK_LINES", size)
    assert (rows(documents.articles(texts)), rows(documents.articles(texts, 5, 20)), rows(documents.paged_lines(texts))) == whole


def test_one_huge_document_is_many_tasks_work(spark, monkeypatch):
    """A document that comes as lines of one file: every block is read by itself, whatever task it is in."""
    monkeypatch.setattr(documents, "BLOCK_LINES", 500)
    i = F.col("id")
    line = F.when(i == 0, "===PAGE 3===").when(i % 1000 == 1, F.concat(F.lit("TITRE "), (i / 1000 + 1).cast("int").cast("string"))).when(i % 100 == 2, F.concat(F.lit("Article "), (i / 100).cast("int").cast("string"), F.lit(" : debut"))).otherwise("texte")
    lines = spark.range(100_000).select(F.lit(1).alias("doc_id"), i.alias("line_no"), line.alias("line"))
    blocks = documents.in_blocks(lines)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks are joined otherwise
    try:
        tasks = [r.n for r in blocks.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1 and max(tasks) < 60_000
    found = documents.articles_of_lines(lines).orderBy("seq").collect()
    assert len(found) == 1000
    assert [(r.number, r.path, r.page, len(r.content.split())) for r in found[:2]] == [("0", "Titre 1", 3, 100), ("1", "Titre 1", 3, 100)]
    assert (found[999].number, found[999].path) == ("999", "Titre 100")


def test_only_long_texts_are_read_in_blocks(spark, monkeypatch):
    """Before, the lines of every text were dealt out by blocks, twice, and joined with what stands before these."""
    monkeypatch.setattr(documents, "BLOCK_LINES", 4)
    seen, read = [], documents.articles_of_lines
    monkeypatch.setattr(documents, "articles_of_lines", lambda lines, *span: seen.append(lines) or read(lines, *span))
    text = "===PAGE 2===\nTITRE I\nArticle 1 : un\nsuite"
    texts = spark.createDataFrame([(1, text), (2, text + "\nfin"), (3, None), (4, "")], "doc_id long, text string")
    got = documents.articles(texts).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, 1, "1", "Titre I", "un suite", 2), (2, 1, "1", "Titre I", "un suite fin", 2)]
    assert {x.doc_id for x in seen[0].collect()} == {2}


def test_cleaning_looks_at_every_character(spark):
    """Only lines with a character that cleaning may change are translated."""
    from lexforge.functions import text as T

    shown = dict(zip(T.EXOTIC_SPACES + T.EXOTIC_DASHES, " " * len(T.EXOTIC_SPACES) + "-" * len(T.EXOTIC_DASHES))) | T.KNOWN_GLYPHS
    chars = [chr(c) for c in [*range(0x20, 0x3100), *range(0xE000, 0x10000), 0x1F600]]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.clean_line(F.col("c")).alias("clean")).collect()
    assert all(x.clean == shown.get(x.c, " " if 0xE000 <= ord(x.c) <= 0xF8FF else x.c) for x in got)
