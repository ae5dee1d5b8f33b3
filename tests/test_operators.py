import datetime
import json

from pyspark.sql import functions as F

from lexforge.operators import answers, corpus, deposits, evaluation, layout, ledger, retrieval, rules
from lexforge.sources import readers, writers
from lexforge.streaming import vectorise

D = datetime.date
TODAY = "2024-06-01"


def day(text):
    return F.to_date(F.lit(text))

USERS = "user_id int, plan string, plan_ends date, quota int, quota_set_on date, role string, suspended_on date"


def users(spark):
    rows = [(1, "cabinet", D(2024, 5, 1), 7, D(2024, 4, 1), "admin", None), (2, "essentiel", None, 3, D(2024, 6, 1), "utilisateur", None), (3, "nope", None, 3, None, "utilisateur", None)]
    return spark.createDataFrame(rows, USERS)


def test_quotas(spark):
    got = {r.user_id: (r.plan, r.quota) for r in ledger.refreshed_quotas(users(spark), ledger.plans(spark), day(TODAY)).collect()}
    assert got == {1: ("gratuit", 10), 2: ("essentiel", 3), 3: ("nope", 10)}


def test_plan_changes(spark):
    who = spark.createDataFrame([(2,)], "user_id int")
    down = {r.user_id: (r.plan, r.quota) for r in ledger.downgraded(users(spark), who, ledger.plans(spark)).collect()}
    assert down[2] == ("gratuit", 3) and down[1] == ("cabinet", 7)
    requests = spark.createDataFrame([(2, "cabinet", "pending", 2), (1, "essentiel", "validee", 1)], "user_id int, code string, status string, months int")
    up = {r.user_id: (r.plan, r.plan_ends, r.quota) for r in ledger.activated(users(spark), requests, ledger.plans(spark), day(TODAY)).collect()}
    assert up[2] == ("cabinet", D(2024, 7, 31), 300) and up[1][0] == "cabinet"


def test_margins_and_catalogue(spark):
    got = {r.code: (r.margin, r.acceptable, r.most_credits) for r in ledger.margins(ledger.plans(spark)).collect()}
    assert got["essentiel"] == (0.55, True, 100) and got["gratuit"][0] is None and got["essai"][1]
    assert [r.code for r in ledger.visible_catalogue(ledger.plans(spark), production=True).collect()] == ["gratuit", "essentiel", "cabinet"]
    changes = spark.createDataFrame([("gratuit", 0, 10, False, False, False), ("essentiel", 5000, 101, False, True, False), ("neuf", 5000, 100, False, True, True), ("cabinet", 1, 0, False, True, True)], "code string, price int, credits int, trial boolean, active boolean, is_new boolean")
    assert {r.code: r.problem for r in ledger.catalogue_changes(ledger.plans(spark), changes).collect()} == {"gratuit": "free_must_stay", "essentiel": "margin_too_low", "neuf": None, "cabinet": "code_taken"}


def test_accounts(spark):
    held = spark.createDataFrame([(2, None)], "deposited_by int, decided_by int")
    who = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    assert {r.user_id: r.reason for r in ledger.removable_accounts(users(spark), held, who).collect()} == {1: "last_admin", 2: "has_deposits", 3: None}
    change = lambda rows: {r.user_id: r.role for r in ledger.with_roles(users(spark), spark.createDataFrame(rows, "user_id int, role string")).collect()}
    assert change([(1, "utilisateur")])[1] == "admin" and change([(1, "utilisateur"), (2, "admin")]) == {1: "utilisateur", 2: "admin", 3: "utilisateur"}


def test_reports_and_preferences(spark):
    reports = spark.createDataFrame([(1, "open", None, None), (2, "open", None, None), (3, "dismissed", "x", None)], "report_id int, status string, correction string, handled_at date")
    said = spark.createDataFrame([(1, "treated", " "), (2, "treated", "fixed"), (3, "treated", "y")], "report_id int, status string, correction string")
    assert {r.report_id: r.status for r in ledger.handled_reports(reports, said, day(TODAY)).collect()} == {1: "open", 2: "treated", 3: "dismissed"}
    row = spark.createDataFrame([({"densite": "compacte"}, {"densite": "x", "autre": "1", "salutation": "true"})], "a map<string,string>, b map<string,string>")
    full, bad = row.select(ledger.preferences(F.col("a")), ledger.preference_problems(F.col("b"))).first()
    assert full["densite"] == "compacte" and full["format_export"] == "pdf" and bad == ["autre", "densite"]


def test_upserts(spark):
    schema = "k int, note int, created_at date, modified_at date"
    old = spark.createDataFrame([(1, 5, D(2024, 1, 1), None)], schema)
    new = spark.createDataFrame([(1, 3, D(2024, 2, 1), None), (2, 4, D(2024, 2, 1), None)], schema)
    got = {r.k: tuple(r)[1:] for r in ledger.upserted(old, new, ["k"]).collect()}
    assert got == {1: (3, D(2024, 1, 1), D(2024, 2, 1)), 2: (4, D(2024, 2, 1), None)}
    assert {r.k: r.note for r in ledger.seeded(old, new, ["k"]).collect()} == {1: 5, 2: 4}


def test_conversation_deletion(spark):
    c = spark.createDataFrame([(1, 9), (2, 8)], "conversation_id int, user_id int")
    m = spark.createDataFrame([(1, 10), (2, 20)], "conversation_id int, message_id int")
    x = spark.createDataFrame([(10, 5), (20, 5)], "message_id int, article_id int")
    assert [t.count() for t in ledger.without_conversation(c, m, x, 1, 9)] == [1, 1, 1]
    assert [t.count() for t in ledger.without_conversation(c, m, x, 1, 8)] == [2, 2, 2]


def test_context_and_documents(spark):
    results = spark.createDataFrame([("q", 2, 20, "A", "2", "", "two"), ("q", 1, 10, "A", "1", "T > S", "one")], "question_id string, rank int, id int, acronym string, number string, path string, content string")
    assert answers.contexts(results).first()["context"] == "[ARTICLE id=10] A - Article 1\nT > S\none\n\n[ARTICLE id=20] A - Article 2\ntwo"
    articles = spark.createDataFrame([(1, "Mentions : 1° la forme ; 2° le capital.")], "article_id int, content string")
    fields = answers.questionnaire(articles)
    assert [(r.key, r.question) for r in fields.orderBy("position").collect()] == [("item_1", "La forme"), ("item_2", "Le capital")]
    filled = answers.clauses(fields, spark.createDataFrame([(1, "item_1", " SARL ")], "article_id int, key string, answer string")).orderBy("position").collect()
    assert [(r.content, r.complete) for r in filled] == [("SARL", True), (answers.TO_COMPLETE, False)]
    diff = spark.createDataFrame([(1, "changed")] * 61 + [(2, "changed"), (2, "added")], "deposit_id int, status string")
    assert [r.deposit_id for r in answers.to_summarise(diff).collect()] == [2]
    asked = spark.createDataFrame([(1, False, 1, False, True), (2, False, 0, False, True), (3, True, 0, False, True), (4, False, 5, True, True)], "question_id int, staff boolean, quota int, refused boolean, synthesised boolean")
    assert {r.question_id: (r.allowed, r.cost) for r in answers.charges(asked).collect()} == {1: (True, 1), 2: (False, 0), 3: (True, 0), 4: (True, 0)}


def test_guards(spark):
    row = spark.createDataFrame([("short", "what is it?"), ("a plausible rewrite of it", "what is it?"), ("x" * 500, "what is it?")], "c string, o string")
    assert [r.g for r in row.select(retrieval.guarded(F.col("c"), F.col("o"), retrieval.REWRITE_BOUNDS).alias("g")).collect()] == ["what is it?", "a plausible rewrite of it", "what is it?"]


def test_vat_from_gross(spark):
    lines = {r.label: r.amount for r in rules.vat(spark.createDataFrame([(1, "11925"), (2, "-5"), (3, "abc")], "id int, amount string"), from_gross=True).collect()}
    assert lines == {"net": 10000, "principal": 1750, "surcharge": 175, "gross": 11925}


def test_bracket_article(spark):
    text = "jusqu'à 2 000 000 : 10 % ; 3.000.000 : 15% ; 5 000 000 : 25 pour cent ; au-delà : 35 %"
    got = spark.createDataFrame([(text,), (text.replace("25", "26"),)], "content string").select(rules.verified_brackets(None, F.col("content")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False]


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, "factual", ["A 1"], False), (2, "off_corpus", [], False), (3, "multi", ["A 9"], False), (4, "multi", [], False), (5, "odd", ["A 2"], False)], "id int, kind string, expected array<string>, must_refuse boolean")
    references = spark.createDataFrame([("A 1", 1), ("A 2", 2)], "reference string, n_texts int")
    assert {(r.id, r.problem) for r in evaluation.question_problems(questions, references).collect()} == {(2, "trap_must_refuse"), (3, "unknown_article"), (4, "no_article"), (5, "ambiguous_article")}
    kinds = {r.kind: (r.n, r.expected) for r in evaluation.composition(questions).collect()}
    assert kinds["factual"] == (1, 25) and kinds["odd"] == (1, None) and kinds["recency"] == (0, 5)


def test_corpus_reports(spark):
    articles = spark.createDataFrame([(1, 1, "1", "p", "c", None), (2, 1, "2", "p", "c", D(2024, 1, 1)), (3, 2, "1", "p", "c", None)], "id int, text_id int, number string, path string, content string, repealed_on date")
    texts = spark.createDataFrame([(1, "A", D(2020, 5, 6)), (2, "B", D(2021, 1, 1))], "id int, acronym string, dated date")
    cited = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "message_id int, article_id int")
    assert corpus.versions_cited(cited, articles, texts).first()["versions"] == ["A (06/05/2020)", "B (01/01/2021)"]
    assert {r.text_id: r.n for r in corpus.citation_counts(cited, articles).collect()} == {1: 2, 2: 1}
    assert corpus.article_of(articles, texts, "A", "2").count() == 0 and corpus.article_of(articles, texts, "A", "1").first()["id"] == 1
    assert {r.id for r in corpus.sampled(articles, 2, 1).collect()} == {1, 2, 3}
    gone = corpus.without_version(articles, spark.createDataFrame([(5, 1)], "deposit_id int, text_id int"), texts, 1)
    assert [t.count() for t in gone] == [1, 1, 1] and gone[1].first()["text_id"] is None
    old = articles.withColumns({"source_sha256": F.lit("s"), "embedding": F.array(F.lit(1.0))})
    fixed = spark.createDataFrame([(1, "1", "new", "s"), (1, "2", "new", "other")], "text_id int, number string, path string, source_sha256 string")
    got = {r.id: (r.path, r.embedding) for r in corpus.repaired_paths(old, fixed).collect()}
    assert got == {1: ("new", None), 2: ("p", [1.0]), 3: ("p", [1.0])}


def test_deposits(spark):
    files = spark.createDataFrame([(1, b""), (2, b"%PDF-1"), (3, b"text"), (4, b"%PDF-1"), (5, b"%PDF-1")], "doc_id int, content binary")
    scanned = spark.createDataFrame([(4, True)], "doc_id int, scanned boolean")
    chunks = spark.createDataFrame([(2, "1"), (4, "1")], "doc_id int, number string")
    assert {r.doc_id: r.problem for r in deposits.arrival_problems(files, scanned, chunks).collect()} == {1: "empty", 2: None, 3: "no_pdf", 4: "scanned", 5: "no_article"}
    rows = spark.createDataFrame([(1, "pending", None, None, ["2"]), (2, "valid", 9, None, None)], "deposit_id int, status string, decided_by int, decided_at date, reviewed array<string>")
    done = deposits.rejected(rows, spark.createDataFrame([(1, 7), (2, 7)], "deposit_id int, actor int"), day(TODAY))
    assert {r.deposit_id: (r.status, r.decided_by) for r in done.collect()} == {1: ("rejected", 7), 2: ("valid", 9)}
    read = deposits.with_reviewed(rows, spark.createDataFrame([(1, "1"), (1, "2")], "deposit_id int, number string"))
    assert {r.deposit_id: r.reviewed for r in read.collect()} == {1: ["1", "2"], 2: []}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n===PAGE 2===\nline one\nline two\n")
    got = readers.paginated_texts(spark, str(tmp_path / "a.txt")).where("page_no = 2 AND line <> ''").orderBy("line_no")
    assert [r.line for r in got.collect()] == ["line one", "line two"]
    (tmp_path / "q.json").write_text(json.dumps([{"titre": "set"}, {"id": 1, "question": "?", "type": "factual", "articles_attendus": ["A 1"], "doit_refuser": False}]))
    assert readers.questions(spark, str(tmp_path / "q.json")).count() == 1
    print_of = readers.fingerprints(spark, str(tmp_path / "a.txt")).first()
    assert print_of["bytes"] == 33 and len(print_of["sha256"]) == 64
    articles = spark.createDataFrame([(1, "Élan vital")], "id int, content string")
    writers.append_articles(articles, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["tokens"] == ["elan", "vital"]


def test_streaming_vectors(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}", [0.5] if i == 0 else None) for i in range(40)], "id long, text string, embedding array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string, embedding array<double>").parquet(str(tmp_path / "in"))

    def embed(texts):
        assert len(texts) <= vectorise.BATCH
        return [[float(len(t)), 1.0] for t in texts]

    vectorise.vectorise_stream(stream, embed, 2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 39 and got.where("id = 12").first()["embedding"] == [3.0, 1.0]


def test_streamed_answers(spark):
    parts = [(1, i, p) for i, p in enumerate(['{"repo', 'nse": "Ab', "c\\", 'n d', '"}'])]
    got = vectorise.shown_answers(spark.createDataFrame(parts, "reply_id int, seq int, fragment string")).orderBy("seq")
    assert [(r.seq, r.shown) for r in got.collect()] == [(1, "Ab"), (2, "Abc"), (3, "Abc\n d")]


def test_simulated_vectors_are_unit_and_stable(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(layout.simulated_vector(F.col("t"), 12).alias("v")).collect()
    assert rows[0].v == rows[1].v != rows[2].v and rows[3].v is None and abs(sum(x * x for x in rows[0].v) - 1) < 1e-9
