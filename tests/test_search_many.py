import random

from pyspark.sql import functions as F

from lexforge.operators import cells, retrieval, substrings


def test_substrings_against_a_loop(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abé.@ ") for _ in range(n))
    rows = [(i, text(r.randint(0, 9)), r.choice([None, "admin", "le"])) for i in range(150)]
    terms = [text(r.randint(0, 6)) for _ in range(150)] + ["admin", "dmi", "zzz", "", None, "l", "le"]
    people = spark.createDataFrame(rows, "user_id int, email string, role string")
    got = {(x.term, x.user_id) for x in substrings.containing(people, "user_id", {"email": F.col("email"), "role": F.col("role")}, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t, i) for i, a, b in rows for t in terms if t and (t in a or t in (b or ""))}


def test_a_common_gram_is_not_read(spark):
    """Every address has the grams of its domain; a term that holds them is looked up by its others."""
    people = spark.range(20_000).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("q@example.org")).alias("email"))
    terms = spark.range(0, 20_000, 100).select(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("q@example.org")).alias("term"))
    found = substrings.containing(people, "user_id", {"email": F.col("email")}, terms)
    assert found.count() == 200


def test_a_gram_of_every_field_is_many_tasks_work(spark, monkeypatch):
    """Terms without a rare gram match every field: its fields are dealt out, none is lost, and none is met twice."""
    monkeypatch.setattr(substrings, "BLOCK", 100, raising=False)
    people = spark.range(3000).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")).alias("email"))
    terms = spark.createDataFrame([("x.o",), ("@",), ("u7",), ("x.org",)], "term string")
    found = substrings.containing(people, "user_id", {"email": F.col("email")}, terms)
    counts = {x.term: x["count"] for x in found.groupBy("term").count().collect()}
    assert counts == {"x.o": 3000, "@": 3000, "x.org": 3000, "u7": 1 + 10 + 100}
    postings = people.select("user_id", F.lit("x.o").alias("gram"), F.col("email").alias("text"))
    fields, asked = substrings._dealt(postings, spark.createDataFrame([("x.o", "x.o", 30)], "term string, gram string, blocks int"), "user_id")
    sizes = [x["count"] for x in fields.groupBy("gram", "block").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200 and asked.count() == 30


def test_index_recall_and_additions(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    path = str(tmp_path / "index")
    cells.build(rows.where("id % 4 > 0"), path, 12)
    cells.add(rows.where("id % 4 = 0"), path)
    assert spark.read.parquet(f"{path}/vectors").count() == rows.where("embedding IS NOT NULL").count()
    questions = rows.select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    pairs = lambda df: {(x.question_id, x.id) for x in df.collect()}
    exact = retrieval.vector_candidates(rows, questions.where("question_id % 10 = 0"), 10)
    assert pairs(cells.search(path, questions.where("question_id % 10 = 0"), 10, 12)) == pairs(exact)
    # as many probes as some questions need are enough for others too
    probes = cells.probes_for(path, questions.where("question_id % 10 = 0"), exact.select("question_id", "id"))
    others = questions.where("question_id % 10 = 5")
    want = pairs(retrieval.vector_candidates(rows, others, 10))
    recall = {p: len(pairs(cells.search(path, others, 10, p)) & want) / len(want) for p in (1, probes)}
    assert recall[probes] >= 0.9 and recall[1] < recall[probes] and probes < 12


def test_index_of_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(30)] + [(90, None), (91, [0.0, 0.0]), (92, [1.0]), (93, [float("nan"), 1.0])], "id long, embedding array<double>")
    path = str(tmp_path / "index")
    cells.build(rows.where("id < 30"), path, 3)
    cells.add(rows.where("id >= 90"), path)
    got = cells.search(path, spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "question_id int, vector array<double>"), 2, 3).orderBy("rank").collect()
    assert [(x.question_id, x.id) for x in got] == [(1, 0), (1, 1)]


def test_vector_candidates_in_blocks(spark, monkeypatch):
    """Questions in several passes, with broadcasts by Spark switched off, equal vectors, several lengths, nulls and zeros."""
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(i, [1.0, float(i)]) for i in range(300, 320)] + [(900, None), (901, [0.0] * 4), (902, [])]
    asked = [(q, r.normal(size=4).tolist()) for q in range(40)] + [(50, [1.0, 0.0]), (51, None), (52, [0.0, 0.0]), (53, [1.0] * 9)]
    articles, questions = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(asked, "question_id long, vector array<double>")
    want = {}
    for q, v in asked:
        for i, u in rows:
            if u and v and len(u) == len(v) and any(u) and any(v):
                score = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                want.setdefault(q, []).append((-round(score, 6), i))
    want = {q: [i for _, i in sorted(x)[:7]] for q, x in want.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (1 << 20, 200):
            monkeypatch.setattr(retrieval, "QUESTION_BYTES", size)
            monkeypatch.setattr(retrieval, "SCORES", 500)
            got = {}
            for x in retrieval.vector_candidates(articles.repartition(3), questions, 7).orderBy("question_id", "rank").collect():
                got.setdefault(x.question_id, []).append(x.id)
            assert got == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
