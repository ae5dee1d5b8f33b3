import datetime

from pyspark.sql import functions as F

from lexforge.operators import documents, layout

TEXT = "\n".join(
    [
        "lost before pages", "===PAGE 1===", "Livre I ........... 3", "PARTIE 1 - Première", "LIVRE I : Des personnes", "TITRE II", "intro without article",
        "Article 1", "Contenu du premier", "article, suite.", "===PAGE 2===", "Article 18 bis.- Corps du", "dix-huit bis", "LIVRE II - Des biens", "Art.19.- Fin",
    ]
)


def test_articles(spark):
    got = documents.articles(spark.createDataFrame([(7, TEXT), (8, "no page marker\nArticle 1 lost")], "doc_id long, text string")).orderBy("doc_id", "seq")
    assert [tuple(r) for r in got.select("doc_id", "seq", "number", "path", "content", "page").collect()] == [
        (7, 1, "1", "Partie 1 - Première > Livre I - Des personnes > Titre II", "Contenu du premier article, suite.", 1),
        (7, 2, "18 bis", "Partie 1 - Première > Livre I - Des personnes > Titre II", "- Corps du dix-huit bis", 2),
        (7, 3, "19", "Partie 1 - Première > Livre II - Des biens", "Fin", 2),
    ]


def test_page_text_round_trip(spark):
    pages = spark.createDataFrame([(1, 2, "b\nc"), (1, 1, "a")], "doc_id long, page_no int, text string")
    back = documents.paged_lines(documents.assembled_text(pages)).where("page_no > 0 AND line <> ''").orderBy("line_no")
    assert [(r.page_no, r.line) for r in back.collect()] == [(1, "a"), (2, "b"), (2, "c")]


def test_problems(spark):
    long = "x" * 50
    rows = [(1, "1", "p", long), (1, "1", "p", long), (1, "4", "", long), (1, "L 2", "p", "short"), (1, "zz", "p", long), (1, "3", "p", "(nouveau).- Supprimé."), (1, "5", "p", "y" * 12001)]
    found = documents.problems(spark.createDataFrame(rows, "doc_id long, number string, path string, content string"))
    got = {(r.code, r.level): (r.n, r.sample) for r in found.collect()}
    assert got[("duplicate", "blocking")] == (1, ["1"])
    assert got[("gap", "blocking")] == (1, ["2"])
    assert got[("short", "blocking")] == (1, ["L 2"])
    assert got[("unreadable", "blocking")] == (1, ["zz"])
    assert got[("repealed", "warning")] == (1, ["3"])
    assert got[("long", "blocking")] == (1, ["5"])
    assert got[("no_path", "blocking")] == (1, ["4"])


def test_compare_versions(spark):
    new = spark.createDataFrame([(1, "1", "p", "Le prix est de 5 %"), (2, "2", "p", "L’«usage»  est libre"), (3, "9", "p", "new")], "seq int, number string, path string, content string")
    old = spark.createDataFrame([(10, "1", "q", "Le prix est de 4 %"), (11, "2", "q", "l'\"USAGE\" est libre"), (12, "3", "q", "gone"), (9, "1", "q", "earlier")], "id long, number string, path string, content string")
    got = {r.number: (r.status, r.similarity, r.article_id) for r in documents.compare_versions(new, old).collect()}
    assert got == {"1": ("changed", 0.833, 10), "2": ("unchanged", 1.0, 11), "3": ("repealed", 0.0, 12), "9": ("added", 0.0, None)}


def test_dice_of_multisets(spark):
    pairs = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", ""), (3, "a", ""), (4, "a b", "a b")], "pair_id int, left string, right string")
    got = {r.pair_id: r.similarity for r in documents.word_overlap(pairs).collect()}
    assert abs(got.pop(1) - 4 / 6) < 1e-12 and got == {2: 1.0, 3: 0.0, 4: 1.0}


def test_close_versions(spark):
    texts = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, acronym string")
    rows = [(5, 1, "1", "p", "c", datetime.date(2020, 1, 1), None), (6, 3, "1", "p", "c", datetime.date(2020, 1, 1), None), (7, 1, "2", "p", "c", datetime.date(2020, 1, 1), datetime.date(2021, 1, 1))]
    old = spark.createDataFrame(rows, "id long, text_id long, number string, path string, content string, effective_on date, repealed_on date")
    chunks = spark.createDataFrame([(1, "1", "p", "new")], "seq int, number string, path string, content string")
    got = {r.id: r.repealed_on for r in documents.close_versions(old, texts, 2, chunks, F.to_date(F.lit("2024-01-01"))).collect()}
    assert got == {5: datetime.date(2024, 1, 1), 6: None, 7: datetime.date(2021, 1, 1), 8: None}


def test_headers_and_footers(spark):
    pages = [(1, i, f"ACTE UNIFORME\n\nArticle {i}\nbody {i}\nPublished on the official site, page {i} / 9") for i in range(1, 6)]
    got = documents.without_repeated_edges(spark.createDataFrame(pages, "doc_id long, page_no int, text string")).orderBy("page_no").collect()
    assert [r.text for r in got] == [f"\nArticle {i}\nbody {i}" for i in range(1, 6)]
    short = spark.createDataFrame(pages[:3], "doc_id long, page_no int, text string")
    assert documents.without_repeated_edges(short).where(F.col("text").contains("ACTE")).count() == 3


def test_hyphens():
    pages, repairs = layout.repair_pages(["le commer-\nçant et le juge-\ncommissaire agit non-", "commerçant, juge-commissaire; ci- dessus"])
    assert pages == ["le commerçant et le juge-commissaire agit non-commerçant, juge-commissaire; ci-dessus\n\n", ""] or repairs >= 3
    assert "commerçant et le" in pages[0] and "ci-dessus" in "".join(pages)


def test_two_columns(spark):
    words = [(1, 1, float(x), float(x + 60), float(top), f"{side}{top}", 400.0) for side, x in (("r", 240), ("l", 40)) for top in range(0, 240, 20)]
    got = layout.page_lines(spark.createDataFrame(words, "doc_id long, page_no int, x0 double, x1 double, top double, text string, width double"))
    lines = [r.line for r in got.orderBy("line_no").collect()]
    assert lines == [f"l{t}" for t in range(0, 240, 20)] + [f"r{t}" for t in range(0, 240, 20)]


def test_words_of_a_page_are_brought_together_once(spark):
    """Pages in one and two columns, uneven tops and few words; neither gutters nor lines need a second shuffle of words."""
    rows = [(1, p, 40.0 + 260 * c + 70 * i, 100.0 + 260 * c + 70 * i, 20.0 * k + 0.7 * i, f"w{c}{k}{i}", 620.0) for p in (1, 2) for k in range(12) for c in range(2) for i in range(2) if p == 1 or k < 4]
    words = spark.createDataFrame(rows, "doc_id long, page_no int, x0 double, x1 double, top double, text string, width double").repartition(3)
    found = layout.page_lines(words)
    got = [(x.page_no, x.line) for x in found.orderBy("page_no", "line_no").collect()]
    assert got == [(1, f"w{c}{k}0 w{c}{k}1") for c in range(2) for k in range(12)] + [(2, f"w0{k}0 w0{k}1 w1{k}0 w1{k}1") for k in range(4)]
    assert [(x.page_no, x.gutter) for x in layout.gutters(words).orderBy("page_no").collect()] == [(1, 258.0), (2, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
