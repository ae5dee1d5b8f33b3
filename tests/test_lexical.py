import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.functions import french
from lexforge.operators import lexical


def test_stems(spark):
    words = ["convocation", "convocations", "générale", "général", "généraux", "sociétés", "société", "articles", "article", "loi", "lois", "le", "a", "L'assemblée", "délai", "délais"]
    got = {r.w: r.t for r in spark.createDataFrame([(w,) for w in words], "w string").withColumn("t", french.terms(F.col("w"))).collect()}
    same = [("convocation", "convocations"), ("générale", "général"), ("général", "généraux"), ("sociétés", "société"), ("articles", "article"), ("loi", "lois"), ("délai", "délais")]
    assert all(got[a] == got[b] != [] for a, b in same)
    assert got["le"] == got["a"] == [] and got["L'assemblée"] == ["assembl"]


def brute(articles, questions, k, okapi):
    """articles: id -> terms; questions: question -> distinct terms."""
    n, mean = len(articles), sum(map(len, articles.values())) / len(articles)
    df = Counter(t for terms in articles.values() for t in set(terms))
    out = {}
    for q, asked in questions.items():
        rows = []
        for i, terms in articles.items():
            tf = Counter(t for t in terms if t in asked)
            if not tf:
                continue
            share = sum(tf.values()) / len(terms)
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(terms) / mean)) for t, x in tf.items())
            rows.append((-round(score, 9), i) if okapi else (-len(tf), -share, i))
        out[q] = [r[-1] for r in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("scoring", [lexical.COVERAGE, lexical.BM25])
@pytest.mark.parametrize("block", [2, 128])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, scoring, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHARD", 40)
    monkeypatch.setattr(lexical, "SEED_BLOCKS", 2)
    r = random.Random(3)
    words = [f"w{k:02d}" for k in range(40)]
    text = lambda n: " ".join(words[min(39, int(r.expovariate(0.12)))] for _ in range(n))
    rows = [(i, text(r.randint(1, 40))) for i in range(150)] + [(200, ""), (201, None), (202, "le la"), (203, rows_of := text(9)), (204, rows_of)]
    asked = [(q, text(r.randint(1, 6))) for q in range(25)] + [(90, "le"), (91, "unknown zzz"), (92, None), (93, "w00")]
    articles, questions = spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(asked, "question_id long, question string")
    index = lexical.add(articles.where("id < 70"), str(tmp_path / "index"))
    index = lexical.add(articles.where("id >= 70"), str(tmp_path / "index"))  # as two additions
    got = {}
    for x in lexical.search(index, questions, 5, scoring).orderBy("question_id", "rank").collect():
        got.setdefault(x.question_id, []).append(x.id)
    terms = {i: [w for w in (t or "").split() if w not in ("le", "la")] for i, t in rows}
    want = brute({i: t for i, t in terms.items() if t}, {q: set((t or "").split()) - {"le"} for q, t in asked}, 5, scoring is lexical.BM25)
    assert {q: ids for q, ids in want.items() if ids} == got
    direct = {}
    for x in lexical.search_articles(articles, questions, 5, scoring).orderBy("question_id", "rank").collect():
        direct.setdefault(x.question_id, []).append(x.id)
    assert scoring is lexical.BM25 or direct == got


def test_a_word_in_every_article_is_not_read(spark, tmp_path):
    """What is looked at does not grow with articles x questions, although each question holds a word of every article."""
    articles = spark.range(20_000).select("id", F.concat(F.lit("partout "), F.concat(F.lit("x"), (F.col("id") % 400).cast("string")), F.lit(" "), F.concat(F.lit("y"), (F.col("id") % 1000).cast("string"))).alias("content"))
    questions = spark.range(300).select(F.col("id").alias("question_id"), F.concat(F.lit("partout x"), (F.col("id") % 400).cast("string"), F.lit(" y"), F.col("id").cast("string")).alias("question"))
    index = lexical.add(articles, str(tmp_path / "index"))
    found, _ = lexical.candidates(index, questions, 20)
    n = found.count()
    assert n < 300 * 200  # of 6,000,000 pairs that share a word
    best = lexical.search(index, questions.where("question_id = 7"), 3).orderBy("rank").collect()
    assert [(x.id, x.matched) for x in best] == [(7, 3), (2007, 3), (4007, 3)]
