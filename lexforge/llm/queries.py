"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, fertility, language_id, license_scan, near_duplicates, packing, periodic_runs, piece_codec, substring_dedup, token_counts, topk_search, url_filter
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries made from the table itself: for each host, and the path of its first page, by that page's number."""
    host, path = url_filter.host_of(F.col("url")), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/([^/?#]+)", 1)
    hosts = pages.where(F.col("url").isNotNull()).groupBy(host.alias("host")).agg(F.min("page_id").alias("m"), F.min_by(path, "page_id").alias("path")).where(F.col("host") != "")
    day = lambda n: F.to_date(F.lit("2024-01-01")) + F.lit(n).cast("int") if isinstance(n, int) else F.date_add(F.to_date(F.lit("2024-01-01")), n.cast("int"))
    entry = lambda name, key, action, n: F.struct(F.lit(name).alias("list_name"), key.alias("key"), F.lit(action).alias("action"), day(n).alias("at"))
    m, deep = F.col("m"), F.concat("host", F.lit("/"), "path")
    rows = F.array(
        entry("hosts", F.col("host"), "block", m % 120), entry("hosts", F.col("host"), "remove", m % 120 + 90), entry("hosts", F.col("host"), "block", m % 120 + 150),
        entry("paths", deep, "allow", m % 120 + 30), entry("paths", deep, "remove", m % 120 + 200),
    )
    return hosts.where((m % 3 == 0) & (F.col("path") != "")).select(F.inline(rows))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 360).cast("int")))
    return url_filter.filter_captures(captures, dated_entries(pages)).select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "decision", "matched_key", "matched_list")


def with_paths(docs: DataFrame) -> DataFrame:
    """Every fifth document is its directory's license file; directories lie one, two or three levels deep."""
    i = F.col("doc_id")
    a, b = F.concat(F.lit("/a"), (i % 3).cast("string")), F.concat(F.lit("/b"), (i % 7).cast("string"))
    depth = F.when(i % 15 == 0, "").when(i % 10 == 0, a).otherwise(F.concat(a, b))
    name = F.when(i % 5 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat(F.lit("/"), "source", depth, F.lit("/"), name))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return license_scan.scan_licenses(docs).select("doc_id", "path", "license", "license_score", "license_via")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null id is in no fold
    model = language_id.train(docs.where(~held_out), _tokenizer("piece_bpe_32k.model"))
    return language_id.identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")).drop("decoded")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*base, "n_a", "n_b", "n_fallback", "entropy", "script", "reason")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of documents whose crc32 is divisible by 10, the words from a place on repeat with a period, by the rest
    of that number."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.greatest(F.size("words"), F.lit(1)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = lambda c: c.cast("int")
    times = whole(F.ceil((n - a) / p))
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", whole(a + 1), whole(p)), times)), F.lit(1), whole(n - a))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), whole(a)), again), " ")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("words", F.when(h % 10 == 0, words))
    return held.select("doc_id", F.when(F.size("words") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(said.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_license_scan, op3_decontamination, op4_topk_search, op5_language_id, op6_token_counts, op7_substring_dedup, op8_piece_codec, op9_packing, op10_near_duplicates,
        op11_quality_rules, op12_periodic_runs, op13_tokenizer_alignment,
    )
}

ORACLES = {
    "op1_url_filter": """
        WITH c AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 360 AS INTEGER) AS fetched_at,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
                list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
        h AS (SELECT host, min(page_id) AS m, arg_min(coalesce(parts[1], ''), page_id) AS path FROM c WHERE url IS NOT NULL AND host <> '' GROUP BY host),
        e AS (
            SELECT list_name, key, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS since FROM (
                SELECT 'hosts' AS list_name, host AS key, unnest(['block', 'remove', 'block']) AS action, unnest([m % 120, m % 120 + 90, m % 120 + 150]) AS d FROM h WHERE m % 3 = 0 AND path <> ''
                UNION ALL SELECT 'paths', host || '/' || path, unnest(['allow', 'remove']), unnest([m % 120 + 30, m % 120 + 200]) FROM h WHERE m % 3 = 0 AND path <> '')),
        v AS (SELECT *, lead(since) OVER (PARTITION BY list_name, key ORDER BY since) AS until FROM e),
        k AS (SELECT page_id, fetched_at, host AS key FROM c
            UNION ALL SELECT page_id, fetched_at, array_to_string(list_slice(string_split(host, '.'), i, 100), '.') FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS i FROM c)
            UNION ALL SELECT page_id, fetched_at, host || '/' || array_to_string(list_slice(parts, 1, i), '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)),
        b AS (
            SELECT page_id, arg_max({'key': v.key, 'list': list_name, 'action': action}, length(v.key) * 2 + CAST(action = 'allow' AS INTEGER)) AS best
            FROM k JOIN v ON k.key = v.key AND action <> 'remove' AND fetched_at >= since AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
        SELECT page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at, CASE WHEN best.action = 'block' THEN 'block' ELSE 'keep' END AS decision, best.key AS matched_key, best.list AS matched_list
        FROM c LEFT JOIN b USING (page_id)""",
    "op2_license_scan": """
        WITH d AS (
            SELECT doc_id, text, '/' || source || CASE WHEN doc_id % 15 = 0 THEN '' WHEN doc_id % 10 = 0 THEN '/a' || doc_id % 3 ELSE '/a' || doc_id % 3 || '/b' || doc_id % 7 END
                || '/' || CASE WHEN doc_id % 5 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path FROM documents),
        x AS (
            SELECT text, string_split(text, chr(10)) AS lines, string_split_regex(text, '@GAP@') AS paragraphs, count(*) AS n FROM d WHERE regexp_matches(text, '@TRIGGER@') GROUP BY text),
        m AS (SELECT *, list_transform(paragraphs, lambda p: regexp_matches(p, '@TRIGGER@')) AS marks FROM x),
        y AS (
            SELECT text, n, list_distinct(list_filter(list_concat(
                list_filter(list_transform(lines, lambda l: trim(l)), lambda l: regexp_matches(l, '@TRIGGER@')), list_filter(paragraphs, lambda p: regexp_matches(p, '@TRIGGER@')),
                [CASE WHEN list_contains(marks, true) THEN array_to_string(list_slice(paragraphs, list_position(marks, true), len(marks) + 1 - list_position(list_reverse(marks), true)), chr(10) || chr(10)) END, text]),
                lambda s: s IS NOT NULL)) AS said FROM m),
        o AS (SELECT text, n, unnest(said) AS line FROM y),
        l AS (SELECT line, sum(n) AS n FROM o GROUP BY line),
        w AS (SELECT line, n, word, count(*) AS tf FROM (SELECT line, n, unnest(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM l) GROUP BY ALL),
        r AS (SELECT word, sum(n) AS df FROM w GROUP BY word),
        total AS (SELECT coalesce(sum(n), 0) AS total FROM l),
        v AS (SELECT line, word, tf * (ln((total + 1) / (df + 1)) + 1) AS w FROM w JOIN r USING (word), total),
        t AS (SELECT i, license, word, count(*) AS tf FROM (SELECT i, license, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM (VALUES @TEMPLATES@) AS q(i, license, text)) GROUP BY ALL),
        tw AS (SELECT i, license, word, tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1) AS tw FROM t LEFT JOIN r USING (word), total),
        scored AS (
            SELECT line, license, round(dot / (norm * size), 6) AS score
            FROM (SELECT line, i, license, sum(w * tw) AS dot FROM v JOIN tw USING (word) GROUP BY ALL) JOIN (SELECT line, sqrt(sum(w * w)) AS norm FROM v GROUP BY line) USING (line) JOIN (SELECT i, sqrt(sum(tw * tw)) AS size FROM tw GROUP BY i) USING (i)),
        best AS (SELECT text, license, score FROM (SELECT text, license, score, row_number() OVER (PARTITION BY text ORDER BY score DESC, license) AS i FROM o JOIN scored USING (line) WHERE score >= @THRESHOLD@) WHERE i = 1),
        own AS (SELECT doc_id, path, license, score FROM d JOIN best USING (text)),
        files AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min({'license': license, 'score': score}, path) AS f FROM own WHERE doc_id % 5 = 0 GROUP BY 1),
        near AS (SELECT d.doc_id, arg_max(f, length(dir)) AS f FROM d JOIN files ON starts_with(d.path, dir || '/') GROUP BY d.doc_id)
        SELECT d.doc_id, d.path, coalesce(own.license, near.f.license) AS license, coalesce(own.score, near.f.score) AS license_score,
            CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.f IS NOT NULL THEN 'directory' ELSE 'none' END AS license_via
        FROM d LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)"""
    .replace("@TRIGGER@", license_scan.TRIGGER)
    .replace("@GAP@", license_scan.GAP)
    .replace("@TEMPLATES@", ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.templates())))
    .replace("@THRESHOLD@", str(license_scan.THRESHOLD)),
    "op4_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
        s AS (
            SELECT q.vec_id AS query_id, q.v AS asked, b.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
            FROM q JOIN v b ON q.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
