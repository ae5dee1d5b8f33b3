"""Registered queries: the operators on the test tables, in the roles given below.

documents are articles, a document's source is its text, embeddings.vec_id is an article's id, benchmark
items are questions, conversations are messages, customers are users, orders are requests and amounts,
order lines are citations, events are ratings, reports and payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import french
from ..functions import text as T
from ..functions.json_stream import partial_answer
from ..operators import answers, corpus, documents, evaluation, layout, ledger, retrieval, rules
from ..sources.kept import kept
from ..sources.readers import listed_numbers, page_numbers, table

QUERIES: dict = {}
ORACLES: dict = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DAY = "DATE '2024-06-01'"


def _date(text: str):
    return F.to_date(F.lit(text))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("source", 4, 10).cast("long")
    docs = table(spark, sf, "documents").select("source").distinct()
    return docs.select(n.alias("id"), F.concat(F.lit("S"), (n % 5).cast("string")).alias("acronym"), F.concat(F.lit("v"), n.cast("string")).alias("version"), F.date_add(_date("2020-01-01"), n.cast("int")).alias("dated"))


def _articles(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    docs = table(spark, sf, "documents")
    base = docs.select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 10).cast("long").alias("text_id"), (F.col("doc_id") % 400).cast("string").alias("number"),
        F.col("lang").alias("path"), F.col("text").alias("content"), F.when(F.col("doc_id") % 7 == 0, _date("2024-06-01")).alias("repealed_on"),
    )
    return base.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left") if vectors else base


_TEXTS = """texts AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, 'S' || CAST(substr(source, 4) AS BIGINT) % 5 AS acronym,
    'v' || CAST(substr(source, 4) AS BIGINT) AS version, DATE '2020-01-01' + CAST(substr(source, 4) AS INTEGER) AS dated FROM documents)"""
_ARTICLES = f"""articles AS (SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS text_id, CAST(doc_id % 400 AS VARCHAR) AS number, lang AS path, text AS content,
    CASE WHEN doc_id % 7 = 0 THEN {_DAY} END AS repealed_on, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


@registered(f"""WITH {_TEXTS}, {_ARTICLES}
    SELECT t.id, acronym, CAST(dated AS VARCHAR) AS dated, count(a.id) AS articles, count(a.embedding) AS vectorised
    FROM texts t LEFT JOIN articles a ON a.text_id = t.id AND a.repealed_on IS NULL GROUP BY ALL""")
def provenance_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.provenance(_texts(spark, sf), _articles(spark, sf, True)).withColumn("dated", F.col("dated").cast("string"))


@registered(f"""WITH {_TEXTS}, {_ARTICLES}
    SELECT t.id, count(a.id) AS articles, count(a.embedding) AS vectorised, count(a.id) > 0 AND count(a.id) = count(a.embedding) AS ready
    FROM texts t LEFT JOIN articles a ON a.text_id = t.id GROUP BY t.id""")
def corpus_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.readiness(_texts(spark, sf), _articles(spark, sf, True))


@registered(f"WITH {_ARTICLES} SELECT round(count(embedding) / count(*), 6) AS coverage FROM articles WHERE repealed_on IS NULL")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.coverage(_articles(spark, sf, True).where("repealed_on IS NULL")).select(F.round("coverage", 6).alias("coverage"))


@registered(f"""WITH {_ARTICLES}
    SELECT a.id, (SELECT max(b.id) FROM articles b WHERE b.text_id = a.text_id AND b.id < a.id AND b.repealed_on IS NULL) AS previous,
        (SELECT min(b.id) FROM articles b WHERE b.text_id = a.text_id AND b.id > a.id AND b.repealed_on IS NULL) AS next FROM articles a""")
def article_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.neighbours(_articles(spark, sf))


@registered(f"""WITH {_ARTICLES}
    SELECT text_id, path, min(id) AS first_id, string_agg(number, ',' ORDER BY id) AS numbers FROM articles GROUP BY text_id, path""")
def outline_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.outline(_articles(spark, sf)).withColumn("numbers", F.array_join("numbers", ","))


@registered(f"""WITH {_ARTICLES} SELECT text_id, count(*) AS n, min(length(content)) AS shortest, max(length(content)) AS longest,
    list_sort(list(length(content)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM articles GROUP BY text_id""")
def size_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.size_summary(_articles(spark, sf))


@registered(f"WITH {_ARTICLES} SELECT id, number, text_id FROM articles WHERE embedding IS NULL AND repealed_on IS NULL")
def pending_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pending_vectors(_articles(spark, sf, True), _texts(spark, sf)).select("id", "number", "text_id")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return asked.join(vectors, "question_id", "left")


_CANDIDATES = f"""{_ARTICLES},
    live AS (SELECT * FROM articles WHERE repealed_on IS NULL),
    q AS (SELECT item_id AS question_id, text AS question, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
    vs AS (SELECT question_id, id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])), 6) AS score FROM live, q WHERE embedding IS NOT NULL AND vector IS NOT NULL),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 20),
    qk AS (SELECT DISTINCT question_id, unnest({french.terms_sql("question")}) AS word FROM q),
    aw AS (SELECT id, len(t) AS length, unnest(t) AS word FROM (SELECT id, {french.terms_sql("content")} AS t FROM live)),
    ls AS (SELECT question_id, id, count(DISTINCT word) AS matched, count(*) / any_value(length) AS share FROM aw JOIN qk USING (word) GROUP BY question_id, id),
    l AS (SELECT question_id, id, round(matched + share, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, share DESC, id) AS rank FROM ls) WHERE rank <= 20),
    f AS (SELECT coalesce(v.question_id, l.question_id) AS question_id, coalesce(v.id, l.id) AS id, coalesce(v.score, 0) AS vector_score, coalesce(l.score, 0) AS lexical_score,
        round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + l.rank), 0), 9) AS rrf, v.rank AS vr, l.rank AS lr FROM v FULL JOIN l ON v.question_id = l.question_id AND v.id = l.id),
    h AS (SELECT question_id, id, vector_score, lexical_score, rrf, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, vr NULLS LAST, lr NULLS LAST, id) AS rank FROM f) WHERE rank <= 8)"""


def _live(spark: SparkSession, sf: str, vectors: bool = True) -> DataFrame:
    return _articles(spark, sf, vectors).where("repealed_on IS NULL")


@registered(f"WITH {_CANDIDATES} SELECT question_id, id, score, rank FROM v")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_candidates(_live(spark, sf), _questions(spark, sf)).select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@registered(f"WITH {_CANDIDATES} SELECT question_id, id, score, rank FROM l")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lexical_candidates(_live(spark, sf, False), _questions(spark, sf)).select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    # vectors exist for a part of the test documents only
    return retrieval.hybrid_search(_live(spark, sf), _questions(spark, sf), least_coverage=0.01, texts=_live(spark, sf, False))


@registered(f"WITH {_CANDIDATES} SELECT question_id, id, vector_score, lexical_score, rrf, rank, CASE WHEN question_id IN (SELECT question_id FROM v) THEN 'hybrid' ELSE 'lexical_only' END AS mode FROM h")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@registered(f"""WITH {_CANDIDATES}, r AS (SELECT question_id, max(vector_score) AS relevance, count(*) AS n FROM h GROUP BY 1)
    SELECT question_id, CASE WHEN coalesce(n, 0) = 0 THEN 'refuse' WHEN vector IS NOT NULL AND coalesce(relevance, 0) < 0.55 THEN 'refuse' ELSE 'answer' END AS route FROM q LEFT JOIN r USING (question_id)""")
def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    found = kept(_hybrid(spark, sf))  # read twice
    counts = found.groupBy("question_id").agg(F.count("*").alias("n_results"), F.max("mode").alias("mode"), F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("relevance"))
    asked = _questions(spark, sf).select("question_id", "question").join(counts.drop("relevance"), "question_id", "left").fillna(0, "n_results")
    return answers.pre_checks(asked, counts.select("question_id", "relevance"))


_MESSAGES = "m AS (SELECT conv_id AS conversation_id, conv_id * 1000 + turn AS message_id, role, text FROM conversations)"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", "text")


@registered(f"WITH {_MESSAGES} SELECT conversation_id, message_id, role FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY message_id DESC) <= 6")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.last_turns(_messages(spark, sf)).select("conversation_id", "message_id", "role")


@registered(f"""WITH {_MESSAGES} SELECT message_id, md5((SELECT b.text FROM m b WHERE b.conversation_id = a.conversation_id AND b.message_id < a.message_id AND b.role = 'user' ORDER BY b.message_id DESC LIMIT 1)) AS question FROM m a""")
def previous_question(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.previous_question(_messages(spark, sf)).select("message_id", F.md5("question").alias("question"))


@registered(f"""WITH {_MESSAGES} SELECT message_id, md5((SELECT b.text FROM m b WHERE b.conversation_id = a.conversation_id AND b.message_id < a.message_id AND b.role <> a.role ORDER BY b.message_id DESC LIMIT 1)) AS other FROM m a""")
def turn_before_by_another(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.turn_before_by_another(_messages(spark, sf)).select("message_id", F.md5("other").alias("other"))


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("id"))


def _cited_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every part that is divisible by three is among the results of every question that cites it."""
    pairs = _citations(spark, sf).where("id % 3 = 0").select("question_id", "id").distinct()
    return pairs.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("acronym"), F.col("p_type").alias("number"), F.col("p_name").alias("path")), "id")


@registered("""SELECT l_orderkey AS question_id, min(l_linenumber) AS position, l_partkey AS id, p_brand AS acronym, p_type AS number
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 3 = 0 GROUP BY ALL""")
def citation_validation(spark: SparkSession, sf: str) -> DataFrame:
    return answers.valid_citations(_citations(spark, sf), _cited_results(spark, sf)).select("question_id", "position", "id", "acronym", "number")


@registered("""SELECT o_orderkey AS question_id, count(DISTINCT CASE WHEN l_partkey % 3 = 0 AND p_partkey IS NOT NULL THEN l_partkey END) AS n_valid,
    o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' OR count(DISTINCT CASE WHEN l_partkey % 3 = 0 AND p_partkey IS NOT NULL THEN l_partkey END) = 0 AS refused
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority""")
def answer_decisions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    confidence = F.when(F.col("o_orderstatus") == "O", "high").when(F.col("o_orderstatus") == "P", "medium").otherwise("insufficient")
    said = orders.select(F.col("o_orderkey").alias("question_id"), confidence.alias("confidence"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("refused_by_model"))
    return answers.decisions(said, _citations(spark, sf), _cited_results(spark, sf))


@registered("SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1")
def rejected_citations(spark: SparkSession, sf: str) -> DataFrame:
    return answers.rejected_citations(_citations(spark, sf), _cited_results(spark, sf)).groupBy("id").agg(F.count("*").alias("n"))


@registered(f"WITH {_ARTICLES} SELECT text_id, number, count(*) AS n FROM articles GROUP BY text_id, number HAVING count(*) > 1")
def duplicate_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _articles(spark, sf).groupBy("text_id", "number").agg(F.count("*").alias("n")).where("n > 1")


@registered("""WITH k AS (SELECT DISTINCT o_custkey AS doc_id, CAST(o_orderkey % 97 AS BIGINT) AS whole FROM orders),
    r AS (SELECT doc_id, unnest(range(min(whole), max(whole))) AS missing FROM k GROUP BY doc_id)
    SELECT doc_id, missing FROM r ANTI JOIN k ON k.doc_id = r.doc_id AND k.whole = r.missing""")
def series_gaps(spark: SparkSession, sf: str) -> DataFrame:
    numbers = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("").alias("series"), (F.col("o_orderkey") % 97).cast("long").alias("whole"))
    return documents.series_gaps(numbers).select("doc_id", "missing")


@registered("""WITH c AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS VARCHAR) AS number, text AS content, CASE WHEN lang = 'es' THEN '' ELSE lang END AS path FROM documents),
    k AS (SELECT DISTINCT doc_id, CAST(number AS BIGINT) AS whole FROM c),
    g AS (SELECT doc_id, unnest(range(min(whole), max(whole))) AS whole FROM k GROUP BY doc_id)
    SELECT doc_id, 'short' AS code, 'blocking' AS level, count(*) AS n FROM c WHERE length(content) < 40 AND NOT regexp_matches(content, '(?i)^[^\\p{L}\\p{N}_]*(abrog|supprim|r[ée]serv)') GROUP BY doc_id
    UNION ALL SELECT doc_id, 'long', 'blocking', count(*) FROM c WHERE length(content) > 12000 AND NOT regexp_matches(content, '(?i)^[^\\p{L}\\p{N}_]*(abrog|supprim|r[ée]serv)') GROUP BY doc_id
    UNION ALL SELECT doc_id, 'repealed', 'warning', count(*) FROM c WHERE regexp_matches(content, '(?i)^[^\\p{L}\\p{N}_]*(abrog|supprim|r[ée]serv)') GROUP BY doc_id
    UNION ALL SELECT doc_id, 'no_path', CASE WHEN count(*) FILTER (path = '') > 0.02 * count(*) THEN 'blocking' ELSE 'warning' END, count(*) FILTER (path = '') FROM c GROUP BY doc_id HAVING count(*) FILTER (path = '') > 0
    UNION ALL SELECT doc_id, 'gap', 'blocking', count(*) FROM g ANTI JOIN k USING (doc_id, whole) GROUP BY doc_id""")
def content_checks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.substring("source", 4, 10).cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("number"), F.col("text").alias("content"), F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("path"))
    return documents.problems(chunks).select("doc_id", "code", "level", "n")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a source are its pages, with a header and a numbered footer."""
    docs = table(spark, sf, "documents")
    head, foot = F.concat(F.lit("COLLECTION "), F.upper("source")), F.concat(F.lit("Published for the collection, page "), F.col("doc_id").cast("string"))
    return docs.select(F.substring("source", 4, 10).cast("long").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"), F.concat_ws("\n", head, F.col("text"), foot).alias("text"))


_EDGES = """p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS INTEGER) AS page_no, 'COLLECTION ' || upper(source) || chr(10) || text || chr(10) || 'Published for the collection, page ' || doc_id AS text FROM documents),
    x AS (SELECT doc_id, page_no, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM p),
    e AS (SELECT *, trim(line) <> '' AND least(row_number() OVER (PARTITION BY doc_id, page_no, trim(line) = '' ORDER BY line_no), row_number() OVER (PARTITION BY doc_id, page_no, trim(line) = '' ORDER BY line_no DESC)) <= 3 AS edge,
        CASE WHEN length(trim(line)) < 20 THEN trim(line) ELSE trim(regexp_replace(regexp_replace(trim(line), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) END AS key FROM x),
    pg AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM e GROUP BY doc_id),
    k AS (SELECT doc_id, key, count(DISTINCT page_no) AS n FROM e WHERE edge AND key <> '' GROUP BY ALL),
    r AS (SELECT doc_id, key, n FROM k JOIN pg USING (doc_id) WHERE pages >= 4 AND n >= greatest(2, pages * 3 // 10))"""


@registered(f"WITH {_EDGES} SELECT doc_id, key, n FROM r")
def header_footer_keys(spark: SparkSession, sf: str) -> DataFrame:
    return documents.repeated_edges(documents.edge_lines(_pages(spark, sf)))


@registered(f"""WITH {_EDGES}, kept AS (SELECT e.* FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.key = e.key AND e.edge WHERE r.key IS NULL)
    SELECT p.doc_id, p.page_no, md5(coalesce(t, '')) AS text FROM p LEFT JOIN (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS t FROM kept GROUP BY ALL) USING (doc_id, page_no)""")
def strip_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.without_repeated_edges(_pages(spark, sf)).select("doc_id", "page_no", F.md5("text").alias("text"))


@registered("SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, sum(length(trim(text, ' '))) < 100 * count(*) AS scanned FROM documents GROUP BY 1")
def scanned_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.scanned_documents(table(spark, sf, "documents").select(F.substring("source", 4, 10).cast("long").alias("doc_id"), "text"))


@registered("""WITH l AS (SELECT doc_id, lang, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS line FROM (SELECT doc_id, lang, string_split(replace(text, '....', '. . . .'), chr(10)) AS lines FROM documents))
    SELECT doc_id, CAST(i // 2 + 1 AS BIGINT) AS seq, CAST(i // 2 + 1 AS VARCHAR) AS number, 'Titre 1 - ' || lang AS path, md5(trim(regexp_replace(string_agg(translate(line, chr(160), ' '), ' ' ORDER BY i), '\\s+', ' ', 'g'))) AS content,
        CAST(CASE WHEN min(i) < 10 THEN 1 ELSE 2 END AS INTEGER) AS page FROM l GROUP BY doc_id, lang, i // 2""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, whose every other line is made the header of an article, over two pages."""
    lines = F.split(F.replace("text", F.lit("...."), F.lit(". . . .")), "\n")
    header = lambda line, i: F.when(i % 2 == 0, F.concat(F.lit("Article "), (F.floor(i / 2) + 1).cast("string"), F.lit(" : "), line)).otherwise(line)
    paged = F.transform(lines, lambda line, i: F.concat(F.when(i == 10, "===PAGE 2===\n").otherwise(""), header(line, i)))
    whole = F.concat(F.lit("before any page\n===PAGE 1===\nTitre 1 : "), F.col("lang"), F.lit("\n"), F.array_join(paged, "\n"))
    found = documents.articles(table(spark, sf, "documents").select("doc_id", whole.alias("text")))
    return found.withColumns({"seq": F.col("seq").cast("long"), "content": F.md5("content")})


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    old = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("number"), F.col("lang").alias("path"), F.col("text").alias("content")).where("id % 5 <> 0")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" amended text"))).otherwise(F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))))
    new = docs.select(F.col("doc_id").cast("int").alias("seq"), F.col("doc_id").cast("string").alias("number"), F.col("lang").alias("path"), changed.alias("content")).where("seq % 4 <> 0")
    return new, old


@registered("""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS number, CASE WHEN doc_id % 4 = 0 THEN 'repealed' WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status,
        CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN round(2.0 * n / (2 * n + 2), 3) ELSE 1.0 END AS similarity
    FROM w WHERE NOT (doc_id % 4 = 0 AND doc_id % 5 = 0)""")
def diff_versions(spark: SparkSession, sf: str) -> DataFrame:
    return documents.compare_versions(*_versions(spark, sf)).select("number", "status", "similarity")


@registered("""SELECT count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 = 0) AS added, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0) AS changed,
    count(*) FILTER (doc_id % 4 = 0 AND doc_id % 5 <> 0) AS repealed, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS unchanged FROM documents""")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return documents.status_counts(documents.compare_versions(*_versions(spark, sf)))


@registered("""WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    c AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(w) AS word FROM t) GROUP BY ALL),
    s AS (SELECT a.item_id, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON b.item_id = a.item_id + 1 AND a.word = b.word GROUP BY a.item_id)
    SELECT t.item_id AS pair_id, round(2.0 * coalesce(common, 0) / (len(t.w) + len(u.w)), 6) AS similarity FROM t JOIN t u ON u.item_id = t.item_id + 1 LEFT JOIN s ON s.item_id = t.item_id""")
def dice_similarity(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", T.collapsed(F.lower("text")).alias("text"))
    pairs = items.alias("a").join(items.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("pair_id"), F.col("a.text").alias("left"), F.col("b.text").alias("right"))
    return documents.word_overlap(pairs).withColumn("similarity", F.round("similarity", 6))


@registered(f"""WITH {_TEXTS}, {_ARTICLES}, o AS (SELECT id FROM texts WHERE acronym = (SELECT acronym FROM texts WHERE id = 3) AND id <> 3)
    SELECT id, text_id, CAST(CASE WHEN repealed_on IS NULL AND text_id IN (SELECT id FROM o) THEN DATE '2025-01-01' ELSE repealed_on END AS VARCHAR) AS repealed_on FROM articles
    UNION ALL SELECT (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY item_id), 3, NULL FROM benchmark""")
def version_close(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.col("item_id").cast("string").alias("number"), F.lit("").alias("path"), F.col("text").alias("content"))
    all_articles = _articles(spark, sf).withColumn("effective_on", _date("2020-01-01"))
    closed = documents.close_versions(all_articles, _texts(spark, sf), 3, chunks, _date("2025-01-01"))
    return closed.select("id", "text_id", F.col("repealed_on").cast("string").alias("repealed_on"))


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 20).cast("decimal(20,2)").alias("amount"))


_BASES = "b AS (SELECT o_orderkey AS id, CAST(CAST(o_totalprice * 20 AS DECIMAL(20,2)) AS DECIMAL(38,10)) AS base FROM orders)"


@registered(f"""WITH {_BASES}, c AS (SELECT id, base, base * 0.175 AS principal, base * 0.0175 AS extra FROM b)
    SELECT id, unnest([1, 2, 3, 4]) AS seq, unnest(['net', 'principal', 'surcharge', 'gross']) AS label, CAST(unnest([round(base, 0), round(principal, 0), round(extra, 0), round(base + principal + extra, 0)]) AS BIGINT) AS amount FROM c""")
def tax_vat(spark: SparkSession, sf: str) -> DataFrame:
    return rules.vat(_bases(spark, sf))


@registered(f"""WITH {_BASES}, c AS (SELECT id, base, base * 0.30 AS principal, base * 0.03 AS extra FROM b)
    SELECT id, unnest([1, 2, 3, 4]) AS seq, unnest(['base', 'principal', 'surcharge', 'total']) AS label, CAST(unnest([round(base, 0), round(principal, 0), round(extra, 0), round(principal + extra, 0)]) AS BIGINT) AS amount FROM c""")
def tax_proportional(spark: SparkSession, sf: str) -> DataFrame:
    return rules.proportional(_bases(spark, sf))


@registered(f"""WITH {_BASES}, s(seq, floor, ceiling, rate, label) AS (VALUES (1, 0, 2000000, 0.10, 'up to 2 000 000'), (2, 2000000, 3000000, 0.15, 'up to 3 000 000'), (3, 3000000, 5000000, 0.25, 'up to 5 000 000'), (4, 5000000, NULL, 0.35, 'beyond 5 000 000')),
    p AS (SELECT id, seq, label, (least(base, coalesce(ceiling, base)) - floor) * rate AS part FROM b JOIN s ON base > floor)
    SELECT id, seq, label, CAST(round(part, 0) AS BIGINT) AS amount FROM p
    UNION ALL SELECT b.id, 0, 'total', CAST(round(coalesce(t, 0) * 1.10, 0) AS BIGINT) FROM b LEFT JOIN (SELECT id, sum(part) AS t FROM p GROUP BY id) USING (id)""")
def tax_progressive(spark: SparkSession, sf: str) -> DataFrame:
    return rules.progressive(_bases(spark, sf), rules.brackets(spark))


@registered("""WITH t(category, rate, low, high) AS (VALUES ('large', 0.00159, 5000000, 2500000000), ('medium', 0.00283, 141500, 4500000), ('small', 0.00494, 50000, 140000)),
    b AS (SELECT o_orderkey AS id, CAST(CAST(o_totalprice * 200 AS DECIMAL(20,2)) AS DECIMAL(38,10)) AS base, ['large', 'medium', 'small'][o_orderkey % 3 + 1] AS category FROM orders)
    SELECT id, category, CAST(round(base * rate, 0) AS BIGINT) AS theoretical, CAST(round(least(greatest(base * rate, low), high), 0) AS BIGINT) AS due, CASE WHEN base * rate < low THEN 'low' WHEN base * rate > high THEN 'high' END AS bound FROM b JOIN t USING (category)""")
def tax_tariff(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.lit("large"), F.lit("medium"), F.lit("small"))
    bases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 200).cast("decimal(20,2)").alias("amount"), F.get(kinds, (F.col("o_orderkey") % 3).cast("int")).alias("category"))
    return rules.tariff(bases, rules.tariffs(spark))


@registered("""WITH c AS (SELECT doc_id % 500 AS number, arg_min(doc_id % 40 || CASE WHEN doc_id % 3 = 0 THEN '.5' ELSE '' END, doc_id) AS stated FROM documents GROUP BY 1),
    r AS (SELECT p_partkey AS name, p_partkey % 600 AS number, p_partkey % 40 || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END AS rate FROM part)
    SELECT 'r' || name AS name, coalesce(stated = rate, false) AS available, CASE WHEN stated IS NULL THEN 'article missing' WHEN stated <> rate THEN 'rate not stated' END AS reason FROM r LEFT JOIN c USING (number)""")
def rate_availability(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("p_partkey")
    stated = F.concat(F.lit(" Le taux est de "), (i % 40).cast("string"), F.when(i % 3 == 0, ",5").otherwise(""), F.when(i % 2 == 0, " %").otherwise(" pour cent"), F.lit(", non de 1"), (i % 40).cast("string"), F.lit(",25."))
    articles = table(spark, sf, "documents").select(i.alias("id"), (i % 500).cast("string").alias("number"), F.concat(F.translate("text", "0123456789", ""), stated).alias("content"))
    written = F.concat((k % 40).cast("string"), F.when(k % 2 == 0, ".5").otherwise(""))
    declared = table(spark, sf, "part").select(F.concat(F.lit("r"), k.cast("string")).alias("name"), written.cast("decimal(10,4)").alias("rate"), written.alias("written"), (k % 600).cast("string").alias("number"))
    return rules.availability(declared, articles)


def _users(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.get(F.array(*(F.lit(p) for p in ("gratuit", "essentiel", "cabinet", "unknown"))), (F.col("c_custkey") % 4).cast("int"))
    i = F.col("c_custkey").cast("int")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), plan.alias("plan"), F.when(i % 5 != 0, F.date_add(_date("2024-05-01"), i % 60)).alias("plan_ends"), (i % 17).alias("quota"),
        F.when(i % 6 != 0, F.date_add(_date("2024-05-15"), i % 30)).alias("quota_set_on"), F.when(i % 50 == 0, "admin").when(i % 10 == 0, "juriste").otherwise("utilisateur").alias("role"), F.when(i % 33 == 0, _date("2024-01-01")).alias("suspended_on"),
    )


_USERS = """u AS (SELECT c_custkey AS user_id, ['gratuit', 'essentiel', 'cabinet', 'unknown'][c_custkey % 4 + 1] AS plan, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-05-01' + CAST(c_custkey % 60 AS INTEGER) END AS plan_ends, CAST(c_custkey % 17 AS INTEGER) AS quota,
    CASE WHEN c_custkey % 6 <> 0 THEN DATE '2024-05-15' + CAST(c_custkey % 30 AS INTEGER) END AS quota_set_on, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 0 THEN 'juriste' ELSE 'utilisateur' END AS role, c_custkey % 33 = 0 AS suspended FROM customer),
    f(code, price, credits, trial) AS (VALUES ('gratuit', 0, 10, false), ('essentiel', 5000, 90, false), ('cabinet', 8000, 150, false), ('essai', 25, 1, true))"""


@registered(f"""WITH {_USERS}, x AS (SELECT u.*, plan <> 'gratuit' AND coalesce(plan_ends < {_DAY}, false) AS ended, quota_set_on IS NULL OR date_trunc('month', quota_set_on) < {_DAY} AS month, coalesce(credits, 10) AS c FROM u LEFT JOIN f ON code = plan)
    SELECT user_id, CASE WHEN ended THEN 'gratuit' ELSE plan END AS plan, CASE WHEN ended THEN 10 WHEN month THEN c ELSE quota END AS quota, CAST(CASE WHEN ended OR month THEN {_DAY} ELSE quota_set_on END AS VARCHAR) AS quota_set_on FROM x""")
def quota_refresh(spark: SparkSession, sf: str) -> DataFrame:
    done = ledger.refreshed_quotas(_users(spark, sf), ledger.plans(spark), _date("2024-06-01"))
    return done.select("user_id", "plan", "quota", F.col("quota_set_on").cast("string").alias("quota_set_on"))


_OFFERS = "offers AS (SELECT 'p' || p_partkey AS code, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size * 100 END AS price, p_partkey % 60 AS credits, p_partkey % 5 = 0 AS trial, p_partkey % 7 > 0 AS active, p_size AS position FROM part)"


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue with a plan for each part."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("code"), F.when(k % 9 == 0, 0).otherwise(F.col("p_size") * 100).cast("int").alias("price"), (k % 60).cast("int").alias("credits"),
        (k % 5 == 0).alias("trial"), (k % 7 > 0).alias("active"), F.col("p_size").cast("int").alias("position"),
    )


@registered(f"""WITH {_OFFERS} SELECT code, CASE WHEN price <> 0 THEN round((price - credits * 25) / price, 6) END AS margin, price = 0 OR trial OR (price - credits * 25) / price >= 0.5 AS acceptable, CAST(floor(price * 0.5 / 25) AS BIGINT) AS most_credits FROM offers""")
def plan_margin(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.margins(_offers(spark, sf))


_ACTIVE = f"(plan = 'gratuit' OR plan_ends IS NULL OR plan_ends >= {_DAY})"


@registered(f"WITH {_USERS} SELECT code, count(user_id) AS n FROM f LEFT JOIN u ON plan = code AND {_ACTIVE} GROUP BY code")
def plan_subscribers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.subscribers(_users(spark, sf), ledger.plans(spark), _date("2024-06-01"))


@registered(f"WITH {_USERS} SELECT CAST(coalesce(sum(price), 0) AS BIGINT) AS revenue FROM f JOIN u ON plan = code AND {_ACTIVE}")
def plan_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.revenue(_users(spark, sf), ledger.plans(spark), _date("2024-06-01"))


@registered(f"""WITH {_USERS} SELECT (SELECT count(*) FROM u) AS users, (SELECT count(*) FROM u WHERE role IN ('juriste', 'admin')) AS staff, (SELECT count(*) FROM u WHERE suspended) AS suspended,
    (SELECT count(DISTINCT source) FROM documents) AS texts, (SELECT count(*) FROM documents) AS articles, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS in_force, (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS vectorised, (SELECT count(*) FROM conversations) AS messages""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.dashboard(_users(spark, sf), _texts(spark, sf), _articles(spark, sf, True), _messages(spark, sf))


@registered(f"""WITH {_USERS}, r AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, ['gratuit', 'essentiel', 'cabinet', 'nope'][o_orderkey % 4 + 1] AS code, o_orderdate AS asked_at FROM orders),
    x AS (SELECT r.*, price, plan, o.waits FROM r LEFT JOIN f USING (code) JOIN u USING (user_id) LEFT JOIN (SELECT c_custkey AS user_id, true AS waits FROM customer WHERE c_custkey % 7 = 0) o USING (user_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY price IS NOT NULL AND code <> plan AND price > 0 DESC, asked_at, request_id) AS turn FROM x)
    SELECT request_id, user_id, CASE WHEN price IS NULL THEN 'unknown_plan' WHEN code = plan THEN 'same_plan' WHEN price = 0 THEN 'downgrade' WHEN waits OR turn > 1 THEN 'already_pending' ELSE 'pending' END AS outcome FROM y""")
def plan_requests(spark: SparkSession, sf: str) -> DataFrame:
    code = F.get(F.array(*(F.lit(p) for p in ("gratuit", "essentiel", "cabinet", "nope"))), (F.col("o_orderkey") % 4).cast("int"))
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), code.alias("code"), F.col("o_orderdate").alias("asked_at"))
    users = _users(spark, sf)
    return ledger.requests_to_accept(requests, users.where("user_id % 7 = 0"), users, ledger.plans(spark))


@registered("""WITH e AS (SELECT user_id AS reference, CASE event_type WHEN 'purchase' THEN 'SUCCESSFUL' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status, ts FROM events)
    SELECT reference, coalesce(arg_min(status, {'a': ts, 's': status}) FILTER (status <> 'PENDING'), arg_max(status, {'a': ts, 's': status})) AS status FROM e GROUP BY reference""")
def payment_states(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "SUCCESSFUL").when(F.col("event_type") == "error", "FAILED").otherwise("PENDING")
    return ledger.payment_states(table(spark, sf, "events").select(F.col("user_id").alias("reference"), status.alias("status"), F.col("ts").alias("at")))


@registered("""SELECT count(*) AS n, round(avg(event_id % 5 + 1), 2) AS mean, array_to_string([count(*) FILTER (event_id % 5 = 0), count(*) FILTER (event_id % 5 = 1), count(*) FILTER (event_id % 5 = 2), count(*) FILTER (event_id % 5 = 3), count(*) FILTER (event_id % 5 = 4)], ',') AS stars FROM events""")
def rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    ratings = table(spark, sf, "events").select((F.col("event_id") % 5 + 1).cast("short").alias("rating"))
    return corpus.rating_summary(ratings).withColumn("stars", F.array_join("stars", ","))


@registered(f"""WITH {_MESSAGES}, r AS (SELECT event_id AS report_id, user_id, event_id % 700 * 1000 AS message_id, CASE WHEN event_type = 'error' THEN 'open' ELSE 'treated' END AS status, ts AS created_at FROM events)
    SELECT report_id, status, c_name AS email, md5(text) AS answer FROM r LEFT JOIN customer ON c_custkey = user_id LEFT JOIN m USING (message_id) ORDER BY status = 'open' DESC, created_at DESC, report_id LIMIT 200""")
def report_register(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    reports = e.select(F.col("event_id").alias("report_id"), "user_id", (F.col("event_id") % 700 * 1000).alias("message_id"), F.when(F.col("event_type") == "error", "open").otherwise("treated").alias("status"), F.col("ts").alias("created_at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return corpus.report_register(reports, users, _messages(spark, sf)).select("report_id", "status", "email", F.md5("answer").alias("answer"))


@registered(f"""WITH {_TEXTS}, {_ARTICLES}, v AS (SELECT o_custkey AS user_id, o_orderkey % 1000 AS article_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'v' || o_orderkey % 20 END AS seen FROM orders)
    SELECT user_id, article_id, acronym, number, CASE WHEN repealed_on IS NOT NULL THEN 'repealed' ELSE 'revised' END AS reason FROM v JOIN articles a ON a.id = article_id JOIN texts t ON t.id = text_id WHERE repealed_on IS NOT NULL OR (seen IS NOT NULL AND seen <> '' AND seen <> version)""")
def version_alerts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    seen = F.when(i % 4 == 0, None).when(i % 4 == 1, "").otherwise(F.concat(F.lit("v"), (i % 20).cast("string")))
    favourites = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (i % 1000).alias("article_id"), seen.alias("seen_version"))
    return ledger.alerts(favourites, _articles(spark, sf), _texts(spark, sf))


@registered("""WITH r AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1),
    n AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE value > 50 GROUP BY ALL)
    SELECT user_id, event_type, CAST(strftime(coalesce(r.ts, n.ts), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS created_at, CASE WHEN n.ts IS NOT NULL AND r.ts IS NOT NULL THEN strftime(n.ts, '%Y-%m-%d %H:%M:%S') END AS modified_at FROM r FULL JOIN n USING (user_id, event_type)""")
def favourites_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    none = F.lit(None).cast("timestamp_ntz").alias("modified_at") if dict(e.dtypes)["ts"] == "timestamp_ntz" else F.lit(None).cast("timestamp").alias("modified_at")
    old = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("created_at")).select("*", none)
    new = e.where("value > 50").groupBy("user_id", "event_type").agg(F.max("ts").alias("created_at")).select("*", none)
    done = ledger.upserted(old, new, ["user_id", "event_type"])
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return done.select("user_id", "event_type", shown("created_at"), shown("modified_at"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    i = F.col("doc_id")
    ref = lambda n: F.concat(F.lit("S "), n.cast("string"))
    questions = labels.select(i.alias("id"), F.array(ref(i % 7), ref(i % 11)).alias("expected"), (F.col("toxic") == 1).alias("must_refuse"))
    replies = labels.select(i.alias("id"), F.array(ref(i % 13)).alias("cited"), F.when(F.col("quality") == 1, "high").otherwise("insufficient").alias("confidence"), F.lit(False).alias("refused"), (i % 23).cast("double").alias("seconds"))
    return evaluation.scored(questions, replies)


@registered("""WITH s AS (SELECT CAST(doc_id % 23 AS DOUBLE) AS seconds, toxic = 1 AS trap, quality <> 1 AS refused, CASE WHEN toxic = 1 THEN quality <> 1 ELSE quality = 1 AND (doc_id % 13 = doc_id % 7 OR doc_id % 13 = doc_id % 11) END AS correct FROM labels)
    SELECT count(*) AS n, round(avg(CAST(correct AS INTEGER)), 4) AS accuracy, round(avg(CASE WHEN trap THEN CAST(refused AS INTEGER) END), 4) AS refusal_accuracy, quantile_cont(seconds, 0.5) AS median_seconds, max(seconds) AS longest_seconds, count(*) FILTER (seconds > 10) AS late FROM s""")
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.report(_scores(spark, sf))


@registered("""WITH r AS (SELECT min(CASE WHEN quality = 1 THEN s END) AS lowest_covered, max(CASE WHEN quality <> 1 THEN s END) AS highest_uncovered FROM (SELECT quality, CASE WHEN quality = 1 THEN 0.5 + doc_id % 37 / 100 ELSE 0.4 - doc_id % 31 / 100 END AS s FROM labels))
    SELECT round(lowest_covered, 6) AS lowest_covered, round(highest_uncovered, 6) AS highest_uncovered, round(lowest_covered - highest_uncovered, 6) AS gap, round((lowest_covered + highest_uncovered) / 2, 6) AS threshold, 'clear' AS verdict FROM r""")
def calibration_gap(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("quality") == 1
    score = F.when(good, 0.5 + F.col("doc_id") % 37 / 100).otherwise(0.4 - F.col("doc_id") % 31 / 100)
    found = evaluation.calibration(table(spark, sf, "labels").select(score.alias("score"), good.alias("covered")))
    return found.withColumns({c: F.round(c, 6) for c in ("lowest_covered", "highest_uncovered")})


@registered("SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1), lambda x: CAST(x AS INTEGER)))), ',') AS numbers FROM pages")
def page_numbers_listed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_join(listed_numbers(F.col("html"), r"track\(([0-9]+)\)"), ",").alias("numbers"))


@registered("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat(range(p_partkey % 7, p_partkey % 7 + p_size % 5 + 1), [p_partkey % 11], range(p_size, p_size + 3)))), ',') AS pages FROM part""")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    said = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    written = said(" ", k % 7, "-", k % 7 + n % 5, ", ", k % 11, " ,", n, "-", n + 2)
    return table(spark, sf, "part").select(k.alias("id"), F.array_join(page_numbers(written), ",").alias("pages"))


@registered("SELECT doc_id, strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS form FROM documents")
def comparison_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.comparison_form(F.col("text")).alias("form"))


@registered("""SELECT c_custkey AS user_id, upper(substr(c_name, 1, 1) || substr(string_split(c_name, '#')[2], 1, 1)) AS initials, '237' || 600000000 + c_custkey AS phone, upper('acte') || ' ' || c_custkey AS reference FROM customer""")
def profile_fields(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    phone = F.concat(F.lit("+237 "), (600000000 + i).cast("string"))
    return table(spark, sf, "customer").select(i.alias("user_id"), T.initials(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.lit("a@b")).alias("initials"), T.phone_number(phone).alias("phone"), T.reference_key(F.lit(" acte"), i.cast("string")).alias("reference"))


#: Headers of articles with a number in the place of {}, and their canonical numbers.
_HEADERS = [
    ("Article {}", "{}"), ("ARTICLE {} bis :", "{} bis"), ("Art.{} - 1.- Le texte", "{}-1"), ("»Article {}", "{}"), ("Article premier.- Objet", "1"), ("Article L {}. Ter", "L {} ter"),
    ("Article {} _bis", "{} bis"), ("Article C{} -", "C {}"), ("Article {} mnonies bis", "{} nonies bis"), ("Article {} A.- Impôt", "{} A"), ("Art. {} du présent acte", None), ("voir l'Article {}", None),
]
_NUMBERS = "[" + ", ".join(f"'{b}'" if b else "NULL" for _, b in _HEADERS) + "]"


@registered(f"SELECT doc_id, replace(({_NUMBERS})[doc_id % {len(_HEADERS)} + 1], '{{}}', CAST(doc_id AS VARCHAR)) AS number FROM documents")
def article_numbers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    header = F.get(F.array(*(F.lit(a) for a, _ in _HEADERS)), (i % len(_HEADERS)).cast("int"))
    line = F.concat(F.replace(header, F.lit("{}"), i.cast("string")), F.when(i % len(_HEADERS) == 0, F.concat(F.lit("\n"), F.col("text"))).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", T.article_number(F.substring_index(line, "\n", 1)).alias("number"))


@registered("""SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks' WHEN 2 THEN 'identity' END AS kind FROM conversations""")
def courtesy_messages(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("conv_id") + F.col("turn")) % 5
    message = F.when(n == 0, "Bonjour !").when(n == 1, "MERCI beaucoup.").when(n == 2, "Qui êtes-vous ?").when(n == 3, F.concat(F.lit("bonjour, "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.courtesy_kind(message).alias("kind"))


@registered("""WITH l AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
    p AS (SELECT d.doc_id, unnest([0, 1, 2]) AS position, unnest(['1°', '2°', '10°']) AS mark, unnest([
        CASE WHEN l.doc_id IS NULL THEN 'to_check' WHEN quality = 1 THEN 'conforming' ELSE 'gap' END, 'to_check', CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 'to_check' ELSE 'gap' END]) AS status,
        unnest([CASE WHEN l.doc_id IS NULL THEN 'Not verified.' ELSE 'stated' END, 'Not verified.', CASE WHEN l.doc_id IS NULL THEN 'Not verified.' ELSE 'absent' END]) AS finding FROM documents d LEFT JOIN l USING (doc_id))
    SELECT doc_id AS article_id, CAST(position AS INTEGER) AS position, mark, status, finding FROM p""")
def checklist_points(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("Les statuts mentionnent : 1° la forme "), F.translate(F.left("text", F.lit(40)), ":;°0123456789", ""), F.lit(" ; 2° sa dénomination, prévue au 6°) ; • 10°) la durée."))
    articles = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), said.alias("content"))
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    reply = lambda position, mark, status, finding: F.struct(F.lit(position).alias("position"), F.lit(mark).alias("mark"), status.alias("status"), F.lit(finding).alias("finding"))
    rows = F.array(reply(0, "[1°] forme", F.when(F.col("quality") == 1, "conforming").otherwise("gap"), "stated"), reply(1, "1", F.lit("gap"), "again"), reply(2, "10", F.when(F.col("toxic") == 1, "odd").otherwise("gap"), "absent"))
    replies = labels.select(F.col("doc_id").alias("article_id"), F.inline(rows))
    return answers.checklist(articles, replies).select("article_id", "position", "mark", "status", "finding")


_L = "A-Za-zÀ-ÿ"
_KEEPS = "{one}.word IS NULL AND ({two}.word IS NOT NULL OR lower({left}) IN (" + ", ".join(f"'{w}'" for w in layout.KEPT_AFTER) + ") OR lower({right}) IN (" + ", ".join(f"'{w}'" for w in layout.KEPT_BEFORE) + "))"


@registered(f"""WITH RECURSIVE
    p AS (SELECT doc_id, regexp_replace(text, '(\\p{{L}}{{4}})(\\p{{Ll}}{{3}})', '\\1-' || chr(10) || '\\2', 'g') AS text FROM documents),
    w AS (SELECT doc_id, unnest(list_concat(list_filter(string_split_regex(text, '[^-\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[{_L}]{{2,}}')), regexp_extract_all(text, '[{_L}]+-[{_L}]+'))) AS word FROM p),
    v AS (SELECT DISTINCT doc_id, lower(word) AS word FROM w),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, regexp_extract(line, '^([a-zà-ÿ]+)', 1) AS r, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM l WHERE trim(line) <> ''),
    n AS (SELECT *, regexp_matches(line, '[{_L}]{{2,}}-$') AND coalesce(regexp_matches(next, '^[a-zà-ÿ]+'), false) AS links, regexp_extract(next, '^([a-zà-ÿ]+)', 1) AS next_r FROM f),
    g AS (SELECT *, coalesce(lag(links) OVER (PARTITION BY doc_id ORDER BY i), false) AS linked, coalesce(lag(links) OVER (PARTITION BY doc_id ORDER BY i), false) AND regexp_full_match(line, '[{_L}]+-') AS piece, rtrim(line, '-') AS body FROM n),
    d AS (
        SELECT g.doc_id, g.i, g.links, b.left_, {_KEEPS.format(one="o", two="t", left="b.left_", right="g.next_r")} AS keeps
        FROM g JOIN (SELECT doc_id, i, regexp_extract(line, '([{_L}]{{2,}})-$', 1) AS left_ FROM g WHERE links AND NOT piece) b ON b.doc_id = g.doc_id AND b.i = g.i
            LEFT JOIN v o ON o.doc_id = g.doc_id AND o.word = lower(b.left_ || g.next_r) LEFT JOIN v t ON t.doc_id = g.doc_id AND t.word = lower(b.left_ || '-' || g.next_r)
        UNION ALL
        SELECT b.doc_id, b.i, true, b.left_, {_KEEPS.format(one="o", two="t", left="b.left_", right="b.next_r")}
        FROM (SELECT g.doc_id, g.i, g.next_r, CASE WHEN d.keeps THEN g.body ELSE d.left_ || g.body END AS left_ FROM d JOIN g ON g.doc_id = d.doc_id AND g.i = d.i + 1 WHERE g.links AND g.piece) b
            LEFT JOIN v o ON o.doc_id = b.doc_id AND o.word = lower(b.left_ || b.next_r) LEFT JOIN v t ON t.doc_id = b.doc_id AND t.word = lower(b.left_ || '-' || b.next_r)),
    c AS (SELECT g.*, d.keeps, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS chain FROM g LEFT JOIN d ON d.doc_id = g.doc_id AND d.i = g.i),
    m AS (SELECT doc_id, min(k) AS k, string_agg(CASE WHEN links THEN left(line, length(line) - 1) || CASE WHEN keeps THEN '-' ELSE '' END ELSE line END, '' ORDER BY i) AS line, count_if(links) AS n FROM c GROUP BY doc_id, chain),
    x AS (SELECT l.doc_id, l.k, coalesce(m.line, '') AS line, coalesce(m.n, 0) AS n FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.k = l.k),
    y AS (SELECT *, regexp_extract_all(line, '{layout.INLINE}', 1) AS a, regexp_extract_all(line, '{layout.INLINE}', 2) AS b, string_split_regex(line, '{layout.INLINE}') AS parts FROM x),
    z AS (SELECT doc_id, k, j, parts[j] AS part, a[j] AS a, b[j] AS b FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM y)),
    q AS (
        SELECT z.doc_id, z.k, string_agg(part || CASE WHEN a IS NULL THEN '' WHEN {_KEEPS.format(one="o", two="t", left="a", right="b")} THEN a || '-' || b ELSE a || b END, '' ORDER BY j) AS line, count(a) AS n
        FROM z LEFT JOIN v o ON o.doc_id = z.doc_id AND o.word = lower(a || b) LEFT JOIN v t ON t.doc_id = z.doc_id AND t.word = lower(a || '-' || b) GROUP BY z.doc_id, z.k)
    SELECT q.doc_id, 1 AS page_no, string_agg(q.line, chr(10) ORDER BY q.k) AS text, CAST(sum(q.n + x.n) AS INTEGER) AS repairs FROM q JOIN x ON x.doc_id = q.doc_id AND x.k = q.k GROUP BY q.doc_id""")
def hyphen_repair(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return layout.without_hyphens(docs.select("doc_id", F.lit(1).alias("page_no"), F.regexp_replace("text", r"(\p{L}{4})(\p{Ll}{3})", "$1-\n$2").alias("text")))


@registered()
def partial_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    whole = F.to_json(F.struct(F.col("text").alias("reponse")))
    return docs.select("doc_id", partial_answer(F.left(whole, (F.length(whole) / 2).cast("int"))).alias("shown"))


@registered()
def simulated_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", layout.simulated_vector(F.col("text"), 32).alias("embedding"))
