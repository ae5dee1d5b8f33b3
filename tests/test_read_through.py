"""Lexical search without an index: one pass over the articles, nothing written, no content moved."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_lexical import brute

from lexforge.functions import french
from lexforge.operators import lexical
from lexforge.plans import queries

SF = "/root/testdata/sf0.001"


def test_terms_at_hand_are_those_of_the_expression(spark):
    r = random.Random(5)
    parts = [*"aeinxzst09-_'.,\n\t\x00\x7f", "é", "É", "é", "œ", "ß", "İ", "K", "Å", "Σ", "’", " ", "\U0001f600", "ñ", "ậ", "tion", "Le ", "LES", " été", "́ ", "日本", "ﬁ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("t", french.terms(F.col("t")).alias("terms")).collect()
    for row in got:
        pieces = row.t.encode().translate(french.SPACED).split()
        assert french.terms_of(row.t) == row.terms == [t for p in pieces for t in french.terms_of(p.decode())], repr(row.t)


@pytest.mark.parametrize("counts, asked, size, remembered", [(1, 7, 1 << 22, 3), (300, 1 << 18, 50, 1 << 19), (1 << 22, 20, 1 << 22, 0)])
def test_reading_through_against_brute_force(spark, monkeypatch, counts, asked, size, remembered):
    for name, value in (("COUNTS", counts), ("ASKED", asked), ("TEXT_BYTES", size), ("REMEMBERED", remembered)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(4)
    words = [f"w{k:02d}" for k in range(30)]
    text = lambda n: " ".join(words[min(29, int(r.expovariate(0.15)))] for _ in range(n))
    rows = [(i, text(r.randint(1, 12))) for i in range(120)] + [(200, ""), (201, None), (202, "le la"), (-3, same := text(9)), (1 << 40, same)]
    held = [(q, text(r.randint(1, 6))) for q in range(12)] + [(90, "le"), (91, "unknown zzz"), (92, None), (93, "w00")]
    articles, questions = spark.createDataFrame(rows, "id long, content string").repartition(3), spark.createDataFrame(held, "question_id long, question string")
    terms = {i: [w for w in (t or "").split() if w not in ("le", "la")] for i, t in rows}
    want = brute({i: t for i, t in terms.items() if t}, {q: set((t or "").split()) - {"le"} for q, t in held}, 5, False)
    got = {}
    for x in lexical.search_articles(articles, questions, 5).orderBy("question_id", "rank").collect():
        got.setdefault(x.question_id, []).append(x.id)
    assert got == {q: ids for q, ids in want.items() if ids}


def test_no_questions_and_no_articles(spark):
    articles, questions = spark.createDataFrame([(1, "mot")], "id long, content string"), spark.createDataFrame([("q", "mot")], "question_id string, question string")
    assert lexical.search_articles(articles, questions.limit(0), 3).collect() == lexical.search_articles(articles.limit(0), questions, 3).collect() == []
    assert [tuple(x) for x in lexical.search_articles(articles, questions, 3).collect()] == [("q", 1, 2.0, 1, 1)]


def test_no_index_is_written(spark):
    """Before, all terms of the articles, their postings and blocks were."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert queries.lexical_topk(spark, SF).count() and (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_no_join_moves_the_contents_of_articles(spark):
    for query in (queries.lexical_topk, queries.hybrid_rrf):
        lines = _plan(query(spark, SF))
        place = lambda line: len(line) - len(line.lstrip(" :+-"))
        at = next(i for i, line in enumerate(lines) if "MapInArrow" in line and "content" in line)
        below = [line for line in lines[at + 1 :]]
        below = below[: next((i for i, line in enumerate(below) if place(line) <= place(lines[at])), len(below))]
        assert below and not any("Join" in line for line in below)


def test_the_gate_searches_once(spark):
    assert not any("MapInArrow" in line for line in _plan(queries.relevance_gate(spark, SF)))
