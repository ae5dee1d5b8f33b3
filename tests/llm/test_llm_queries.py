"""Queries of the subpackage against their SQL, on empty tables, and with clashing columns."""

import hashlib
import random

import pytest
from oracle import FOLDER, compare
from pyspark.sql import functions as F

from lexforge.llm import alignment, common, decontamination, fertility, language_id, license_scan, near_duplicates, packing, periodic_runs, piece_codec, queries, substring_dedup, token_counts, topk_search, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_numbers_and_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def applied(docs, path):
    """Every operator on documents, as its number and result."""
    items = docs.sparkSession.createDataFrame([(1, "an item of a benchmark that stands nowhere at all")], "item_id long, text string")
    yield 2, license_scan.scan_licenses(docs.withColumn("path", F.lit("/a/b.txt")))
    yield 3, decontamination.find_items(docs, items)
    yield 5, language_id.identify(docs, language_id.train(docs.withColumn("lang", F.lit("en")), path("piece_bpe_32k.model")))
    yield 6, token_counts.count_tokens(docs, path("byte_bpe_50k.json"))
    yield 7, substring_dedup.removal_digests(docs)
    yield 8, piece_codec.encode_digests(docs, path("piece_bpe_32k.model"))
    yield 9, packing.pack(docs, path("piece_bpe_32k.model"))
    yield 10, near_duplicates.near_duplicates(docs)
    yield 11, fertility.judge_documents(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    yield 12, periodic_runs.find_runs(queries.with_planted_periods(docs))
    yield 13, alignment.align_tokenizers(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def test_empty_tables(spark, tokenizers_path):
    for number, result in applied(spark.createDataFrame([], "doc_id long, text string"), tokenizers_path):
        assert result.count() == 0, number
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(topk_search.integer_vectors(none, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0
    entries = spark.createDataFrame([], "list_name string, key string, action string, at date")
    assert url_filter.filter_captures(spark.createDataFrame([], "url string, fetched_at date"), entries).count() == 0
    one = spark.createDataFrame([("http://a.b/c",)], "url string").withColumn("fetched_at", F.to_date(F.lit("2024-01-01")))
    assert url_filter.filter_captures(one, entries).first()["decision"] == "keep"


def test_nulls_repeats_and_clashing_columns(spark, tokenizers_path):
    long = "word " * 3000
    rows = [(1, None, "x"), (2, "", "x"), (3, "same text of six words here", "x"), (3, "same text of six words here", "x"), (4, long, "x"), (5, "\n\t ", None), (None, "words of a row without an id", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("n", "key", "shard", "spans", "__spans", "source", "part", "lang_pred", "score", "component")})
    rows_of = {2: 8, 3: 0, 5: 8, 6: 8, 7: 8, 8: 8, 10: 8, 11: 8, 12: 8, 13: 8}
    for number, result in applied(docs, tokenizers_path):
        if number == 9:
            assert sorted(str(x.doc_id) for x in packing.unpack(result).collect()) == ["3", "3", "4", "5", "None"]
        else:
            assert result.count() == rows_of[number], number
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert groups == {1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (1, 4), 5: (0, 5)}


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, FOLDER, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "piece_codec"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        assert kept.count() > 0, name


def test_pipeline_against_brute_force(spark, tmp_path, tokenizers_path):
    """All stages over a small corpus with repeated and null ids, null texts and clashing columns, against plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece
    from test_near_duplicates import brute
    from test_search_and_filters import edits

    r = random.Random(12)
    english = "the and of to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()
    french = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas plus par sur faire avec tout nous".split()
    text = lambda words, n: " ".join(r.choice(words) + r.choice(["", "", "s"]) for _ in range(n))
    item, passage, base = text(english, 30), text(english, 40), text(english, 90)
    rows = [(i, text(english if i % 3 else french, 60), "en" if i % 3 else "fr") for i in range(24)]
    rows += [(30, base, "en"), (31, base + " more", "en"), (32, base, None), (33, "1234 5678 !", "en"), (34, None, "en"), (35, "", None), (36, "½ ②", "en")]
    rows += [(40 + i, text(english, 50) + " " + passage + " " + text(english, 50), "en") for i in range(4)]
    rows += [(50, text(english, 20) + " " + item.upper() + " " + text(english, 20), "en"), (51, text(english, 20) + " " + item[:50] + item[51:] + " " + text(english, 20), "en")]
    rows += [(20, text(english, 70), "en"), (None, base + " again", "en"), (None, text(french, 70), "fr"), (7, rows[7][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key": F.lit("clash"), "spans": F.lit("clash")})
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    # language: by the operator's own model, whose fit and scores have a brute-force test of their own
    model = language_id.train(docs, tokenizers_path("piece_bpe_32k.model"))
    scorer = language_id.Scorer(model)
    judged = zip(rows, *scorer.predict([t for _, t, _ in rows]))
    kept = [(i, t) for (i, t, _), language, score in judged if language != "und" and score > 0.5]
    assert {i for i, *_ in rows} - {i for i, _ in kept} == {33, 34, 35, 36}
    # near duplicates: rows numbered, those of an id linked, and the smallest id of each group stays
    labels = {i: c for i, (_, c) in brute(list(enumerate(t for _, t in kept))).items()}
    parent = dict(labels)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for k, (i, _) in enumerate(kept):
        if i is not None:
            a, b = find(k), find(by_id.setdefault(i, k))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(kept)):
        groups.setdefault(find(k), []).append(k)
    stay = []
    for members in groups.values():
        ids = {kept[k][0] for k in members} - {None}
        stay += [k for k in members if kept[k][0] == min(ids)] if ids else members[:1]
    kept = [kept[k] for k in sorted(stay)]
    # repeated passages, by document in the order of ids; rows of one id are one document, those without lose nothing
    seen, cut = {}, []
    for i, t in sorted((x for x in kept if x[0] is not None), key=lambda x: x[0]):
        b = t.encode()
        for p in range(len(b) - 99):
            seen.setdefault(b[p : p + 100], (i, p))
    for i, t in kept:
        b = t.encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99) if i is not None else ():
            if seen[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = [True] * 100
        cut.append((i, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    # benchmark items with up to 5 % edits
    plain = decontamination.normalised(item)
    clean = [(i, t) for i, t in cut if not t or edits(plain, decontamination.normalised(t)) > int(0.05 * len(plain))]
    assert {i for i, _ in cut} - {i for i, _ in clean} >= {50, 51}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in clean for ids in [library.encode(t)])
    assert got == want
