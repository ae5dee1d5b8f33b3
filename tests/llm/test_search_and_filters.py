import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import decontamination as dc
from lexforge.llm import license_scan, topk_search, url_filter


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(500):
        p, t = ("".join(r.choice("ab c") for _ in range(r.randint(a, 30))) for a in (1, 0))
        assert dc.best_end(dc.alphabet_masks(p), len(p), t, 0, len(t))[0] == edits(p, t)


def test_decontamination(spark, docs):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() + "x"
    items = [(i, text(r.randint(20, 120))) for i in range(15)] + [(90, None), (91, " "), (92, "ab")]
    texts = [text(400) for _ in range(10)]
    for _ in range(60):
        _, item = r.choice(items[:15])
        changed = list(item)
        for _ in range(r.randint(0, 8)):
            k = r.randrange(len(changed))
            changed[k : k + 1] = r.choice([[], [changed[k], "z"], ["z"]])
        texts.append(text(r.randint(0, 200)) + " " + "".join(changed).upper() + "\n" + text(r.randint(0, 200)))
    texts += ["", None]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_edits for x in dc.find_items(docs(texts), table).collect()}
    want = {}
    for i, t in enumerate(texts):
        for item_id, item in items:
            p, s = dc.normalised(item or ""), dc.normalised(t or "")
            if p and s and (d := edits(p, s)) <= int(len(p) * dc.ERROR_RATE):
                want[i, item_id] = d
    assert got == want
    kept = {x.doc_id for x in dc.drop_contaminated(docs(texts), table).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 30)
    items = spark.createDataFrame([(i, f"benchmark item number {i} of several") for i in range(6)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.find_items(docs([f"before BENCHMARK  item number {i} of several." for i in range(6)]), items).where("n_edits = 0").collect()}
    assert got == {(i, i) for i in range(6)}


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=6).astype(float).round(2).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[50][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2050, [float("nan")] * 6), (3000, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for x in topk_search.top_k(topk_search.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    usable = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if v and all(x is not None and x == x for x in v)}
    for q in [i for i in usable if i % 50 == 0]:
        scores = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:5]
        assert sorted(got.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not got


@pytest.mark.parametrize("held", [1, 8])
def test_top_k_of_long_vectors_in_many_blocks(spark, monkeypatch, held):
    # blocks are of few vectors, and with one histogram at a time a block of queries is counted in several turns
    monkeypatch.setattr(topk_search, "HELD", held)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 16 * 8 * 768)
    x = np.random.default_rng(5).normal(size=(200, 768))
    x[::7] *= 4000.0  # wider components
    vectors = topk_search.integer_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    whole = np.floor(256 * x).astype(np.int64)
    scores = whole @ whole.T
    want = {(q, r + 1, int(i), int(scores[q, i])) for q in range(0, 200, 3) for r, i in enumerate(sorted((i for i in range(200) if i != q), key=lambda i: (-scores[q, i], i))[:5])}
    assert {tuple(r) for r in topk_search.top_k(vectors, F.col("vec_id") % 3 == 0).collect()} == want


def test_top_k_of_repeats_nulls_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [9.0, 9.0]), (50, [1e8, 0.0]), (50, [0.0, 1.0])] + [(i, [i / 16, -1.0]) for i in range(1, 9)] + [(3, [3 / 16, -1.0])]
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for x in topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert sorted(got[0]) == [(1, 50, 256 * 256 * 10**8), (2, 8, 128 * 256), (3, 7, 112 * 256)]
    assert sorted(got[50]) == [(1, 0, 0), (1, 0, 256 * 256 * 10**8), (2, 0, 0), (2, 0, 256 * 256 * 10**8), (3, 1, -65536), (3, 8, 128 * 256 * 10**8)]


@pytest.mark.parametrize("rows", [[(50, [1.0, 1.0]), (1, [1e30, 1.0])], [(50, [1e10, 0.0]), (1, [1e10, 0.0])]])
def test_top_k_beyond_64_bits(spark, rows):
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk_search.top_k(vectors, F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_empty_vectors_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [1.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("dim", "part", "n", "ids", "vector", "score", "rank")})
    got = topk_search.top_k(topk_search.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == [(0, 1, 1, 0)]


def test_top_k_in_another_order_at_each_evaluation(spark):
    r = np.random.default_rng(7)
    usable = {i: r.integers(-50, 50, 4) for i in range(600)}
    rows = [(i, v.tolist()) for i, v in usable.items()] + [(0, [1, 2])]  # an id in two lengths: two blocks with one first id
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").coalesce(1)
    shuffled = df.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), df.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = topk_search.top_k(shuffled, F.col("vec_id") % 2 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    got = {}
    for x in found:
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q in range(0, 600, 2):
        scores = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_url_filter(spark):
    d = datetime.date
    entries = [
        ("l", "bad.org", "block", d(2024, 1, 10)), ("l", "bad.org", "remove", d(2024, 3, 1)), ("l", "bad.org/ok", "allow", d(2024, 1, 20)), ("m", "x.bad.org", "allow", d(2024, 2, 1)),
        ("l", None, "block", d(2024, 1, 1)), ("l", "10.0.0.1", "block", d(2024, 1, 1)), ("l", "0.0.1", "block", d(2024, 1, 1)),
    ]
    cases = [
        ("http://a.bad.org/x", d(2024, 1, 9), "keep"), ("http://a.bad.org/x", d(2024, 1, 10), "block"), ("https://u@BAD.org:80/ok/y?z", d(2024, 1, 25), "keep"), ("http://bad.org/okay", d(2024, 1, 25), "block"),
        ("http://bad.org/", d(2024, 3, 1), "keep"), ("http://x.bad.org/q", d(2024, 2, 2), "keep"), ("http://y.bad.org/q", d(2024, 2, 2), "block"), ("http://10.0.0.1/", d(2024, 5, 5), "block"),
        (None, d(2024, 2, 2), "keep"), ("no url", d(2024, 2, 2), "keep"), ("http://bad.org/", None, "keep"), ("http://notbad.org/", d(2024, 2, 2), "keep"),
    ]
    captures = spark.createDataFrame([(i, u, at, "clash") for i, (u, at, _) in enumerate(cases)] * 2, "i int, url string, fetched_at date, decision string")
    out = url_filter.filter_captures(captures, spark.createDataFrame(entries, "list_name string, key string, action string, at date")).collect()
    assert len(out) == 2 * len(cases) and all(r.decision == cases[r.i][2] for r in out)


def test_licenses(spark):
    notices = {}
    for name, text in license_scan.NOTICES:
        notices.setdefault(name, text)
    mit, gpl = notices["MIT"], notices["GPL-3.0"]
    rows = [
        ("/r/LICENSE", gpl), ("/r/a/LICENSE.txt", "x\n" + mit), ("/r/a/b/c.txt", "plain"), ("/r/d/e.txt", "plain"), ("/r/a/own.txt", "code\n  " + gpl + "\nmore"), ("/other/x", None), (None, mit), (None, None), ("/r/d/odd", "a license to kill time"),
        ("/r/d/e.txt", "code\n" + mit),
    ]
    docs = spark.createDataFrame(rows + rows[:1], "path string, text string").withColumns({c: F.lit("clash") for c in ("license", "own", "near", "own_score", "near_score", "__dir", "key", "dir", "mine", "theirs", "n")})
    out = license_scan.scan_licenses(docs)
    assert out.columns == [c for c in docs.columns if c != "license"] + ["license", "license_score", "license_via"] and out.count() == len(rows) + 1
    got = {(r.path, r.text == rows[-1][1] if r.path == "/r/d/e.txt" else None, r.license, r.license_via) for r in out.collect()}
    assert got == {
        ("/r/LICENSE", None, "GPL-3.0", "own"), ("/r/a/LICENSE.txt", None, "MIT", "own"), ("/r/a/b/c.txt", None, "MIT", "directory"), ("/r/d/e.txt", False, "GPL-3.0", "directory"), ("/r/a/own.txt", None, "GPL-3.0", "own"),
        ("/other/x", None, None, "none"), (None, None, "MIT", "own"), (None, None, None, "none"), ("/r/d/odd", None, "GPL-3.0", "directory"), ("/r/d/e.txt", True, "MIT", "own"),
    }


def test_license_files_and_headers(spark):
    """Whole license files with the holders' names, their first paragraphs, and headers within sources."""
    full = {name: text for name, text in license_scan.templates() if text.count("\n") > 10}
    named = lambda name: full[name].replace("<year>", "2019").replace("<copyright holders>", "Jane Doe and others").replace("<owner>", "The Project")
    rows = [(f"/{name}/LICENSE", named(name), name) for name in full]
    rows += [("/two/LICENSE", "\n\n".join(named("MIT").split("\n\n")[1:3]), "MIT"), ("/bsd/x.c", "/*\n" + "\n".join(" * " + x for x in named("BSD-3-Clause").splitlines()) + "\n */\nint main() { return 0; }\n", "BSD-3-Clause")]
    apache = next(t for n, t in license_scan.NOTICES if n == "Apache-2.0" and len(t) > 300).replace(". ", ".\n#\n# ")
    rows += [("/apache/x.py", "# Copyright 2020 Someone\n#\n# " + apache + "\n\nimport os\n\nprint(os.name)\n" * 5, "Apache-2.0")]
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.\n"
    rows += [("/gpl/x.c", gpl + "\nint f(int x);\n", "GPL-2.0"), ("/none/x", "He had a license to fish, and copyright bored him.\n\nNothing else was said.", None)]
    docs = spark.createDataFrame(rows, "path string, text string, want string")
    wrong = [(r.path, r.want, r.license, r.license_score) for r in license_scan.scan_licenses(docs).collect() if r.license != r.want]
    assert not wrong
