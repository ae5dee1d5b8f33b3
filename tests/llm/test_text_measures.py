"""Quality rules, periodic runs and tokenizer alignment against brute force and the tokenizer libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexforge.llm import alignment, fertility, periodic_runs, queries, vocabularies
from lexforge.llm.suffix_tree import SuffixTree

ODD = ["", None, "a", "  two  spaces ", " \n x\t\ty  \r\n\n z ", "<|endoftext|> in <s> text </s>", "under▁score", "nul\0byte \x1c \x85 \xa0 x  y", "日本語のテキスト と 漢字", "🙂🙂 é ÿ", "x" * 3000, "a b " * 400, "don't we've I'll 'tis", "1234567 89,10.5", "\n", " ", "\t", "ab" * 700 + " " + "ba" * 9]


def sentences(r, n):
    words = ["the", "of", "and", "corpus", "naïve", "Token", "isation,", "x1", "über", "\n\n", "", "line\nbreak", "(brackets)", "…"]
    return [" ".join(r.choice(words) + r.choice(["", "", "s", "ing"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    found, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            if w[k] != w[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and w[k] == w[k + q]:
                k += 1
            stop = k + q
            smallest = not any(all(w[i] == w[i + p] for i in range(start, stop - p)) for p in range(1, q))
            if stop - start >= max(12, 2 * q) and smallest:
                found.add((start, stop - start, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def repetitive(r):
    n, size = r.randint(1, 90), r.choice([1, 2, 2, 3, 5])
    if r.random() < 0.5:
        return [r.randrange(size) for _ in range(n)]
    w = []
    while len(w) < n:
        w += [r.randrange(size + 3) for _ in range(r.randint(1, 9))] * r.randint(1, 5)
        if r.random() < 0.3:
            w.append(100 + len(w))
    return w


def test_runs_of_words():
    r = random.Random(5)
    for _ in range(1500):
        w = repetitive(r)
        assert [tuple(x) for x in periodic_runs.runs_of(np.array(w)).tolist()] == brute_runs(w), w


def test_common_extensions():
    r = random.Random(6)
    for _ in range(60):
        w = repetitive(r)
        tree = SuffixTree([x + 1 for x in w])
        tree.prepare()
        a, b = np.array([(a, b) for a in range(len(w)) for b in range(len(w) + 1) if a != b]).reshape(-1, 2).T
        want = [next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0) for i, j in zip(a.tolist(), b.tolist())]
        assert tree.common(a, b).tolist() == want
        order = sorted(range(len(w) + 1), key=lambda i: w[i:])
        assert np.argsort(tree.suffix_ranks()).tolist() == order
        assert np.argsort(tree.suffix_ranks(descending=True)).tolist() == sorted(range(len(w) + 1), key=lambda i: [-x for x in w[i:]])


def test_op12_against_brute_force(spark, docs, tmp_path):
    r = random.Random(7)
    rows = list(enumerate(sentences(r, 60) + ODD + [" ".join(f"w{x}" for x in repetitive(r)) for _ in range(120)]))
    rows += [(-(2**63), "a b c " * 30), (2**63 - 1, "x y " * 9), (5, "x y " * 9), (None, "p q " * 10), (None, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        w = words_of(text)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(w)
        start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), start, length, period, length and 1000 * length // period, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(kept)))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_text_with_many_words(spark, docs):
    text = " ".join(str(k * 7919 % 30_000) for k in range(80_000))
    assert [tuple(x) for x in periodic_runs.find_runs(docs([text])).first()["runs"]] == [(0, 80_000, 30_000)]


def brute_base(text):
    words = words_of(text)
    windows = Counter(zip(*(words[k:] for k in range(5))))
    again = {k + i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(5)}
    lines, seen, repeated = (text or "").split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(again)


def test_op11_against_brute_force(spark, docs, tmp_path, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(8)
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    line = "a line that stands here and there\n"
    texts = ODD + sentences(r, 80) + [line * 3 + t for t in sentences(r, 20)] + ["# $ % | <x> & * >"] + [" ".join(r.choice("xqzjk") * 3 + str(r.random()) for _ in range(40)), "кот и пёс гуляют по улице в большом городе каждый день вместе"]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op11_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        x, base = got[i], brute_base(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base, text
        assert x.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        words = words_of(text)
        ids = [t for w in words for t in b.encode(w)]
        assert (x.n_a, x.n_b, x.n_fallback) == (sum(len(a.encode(" " + w, add_special_tokens=False).ids) for w in words), len(ids), sum(map(b.is_byte, ids))), text
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert x.entropy == pytest.approx(-sum(s * math.log2(s) for s in shares))
        assert not (x.kept and x.base_failed) and x.kept == (x.reason is None)
    assert got[len(texts) - 1].script == "CYRILLIC" and got[len(texts) - 1].kept
    assert {x.reason for x in got.values()} >= {None, "base"}


def test_bands(spark, docs, paths):
    prose = "This is a plain sentence about the weather and the long road that leads from the old town to the sea."
    texts = [prose, "qzxj9!kq@w#4v^7 " * 3 + " ".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(30)), "ᚠᚢᚦ " * 2 + " ".join(chr(0x16A0 + k) * 3 for k in range(30))]
    measured = fertility.measure(docs(texts), *paths)
    strict = {"LATIN": fertility.Band(2.5, 9, 2.5, 9, 0.1, 5.0), "OTHER": fertility.Band(0.1, 9, 0.1, 9, 0.5, 1.0)}
    assert [x.reason for x in fertility.judge(measured, strict).orderBy("doc_id").collect()] == [None, "few characters per token", "bytes"]
    others = {"LATIN": fertility.Band(0, 2, 0, 9, 1, 0), "OTHER": fertility.Band(0, 9, 0, 9, 1, 99)}
    assert [x.reason for x in fertility.judge(measured, others).orderBy("doc_id").collect()] == ["many characters per token", None, "entropy"]
    assert [x.kept for x in fertility.judge(measured).orderBy("doc_id").collect()][0]


def test_chunks_encoded_together(paths):
    from tokenizers import Tokenizer

    r = random.Random(9)
    chunks = sorted({c for t in ODD + sentences(r, 200) if t for c in alignment.Aligner.chunks_of(t)})
    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    ids, counts = vocabularies.ByteVocabulary(paths[0]).encode(chunks)
    want = [library.encode(c, add_special_tokens=False).ids for c in chunks]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [t for x in want for t in x]


def brute_alignment(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    spell = vocabularies.ByteVocabulary(paths[0]).bytes
    rows, held, linked = [], [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        of_a = [spell[i] for i in ids_a]
        if not b"".join(of_a) == whole == b"".join(of_b):
            ids_a, ids_b, of_a, of_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in of]).tolist() for of in (of_a, of_b))
        common, groups, links = sorted(set(ends_a) & set(ends_b)), [], Counter()
        before = 0
        for end in common:
            x, y = ([i for i, e in zip(ids, ends) if before < e <= end] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)))
            groups.append((x, y))
            for i in x:
                for j in y:
                    links[i, j] += 1
            before = end
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
        held.append(links)
        linked.update(links.keys())
    most = {}
    for (i, _), n in linked.items():
        most[i] = max(most.get(i, 0), n)
    total = Counter()
    for links in held:
        total.update(links)
    sums = [(sum(n for p, n in links.items() if linked[p] == most[p[0]]), sum(n * linked[p] for p, n in links.items())) for links in held]
    return [(*r, *s) for r, s in zip(rows, sums)], linked, total


@pytest.mark.parametrize(("block_docs", "block_postings", "written_out"), [(1 << 16, 1 << 20, 1 << 12), (16, 40, 2)])
def test_alignment_against_brute_force(spark, docs, paths, monkeypatch, block_docs, block_postings, written_out):
    r = random.Random(10)
    texts = ODD + sentences(r, 150) + ["the same text again and again"] * 40
    want, linked, total = brute_alignment(texts, paths)
    # limits that tasks see are taken from the module, in a worker of its own
    if block_docs != alignment.BLOCK_DOCS:
        for name, value in (("BLOCK_DOCS", block_docs), ("BLOCK_POSTINGS", block_postings), ("_WRITTEN_OUT", written_out)):
            monkeypatch.setattr(alignment, name, value)
        aligner = alignment.Aligner(*paths)
        rows, keys, links = [], [], []
        for some, owner, pair, times in aligner.align([t or "" for t in texts]):
            keys += [(p, o + len(rows)) for p, o in zip(pair.tolist(), owner.tolist())]
            links += times.tolist()
            rows += some
        assert [x[:4] for x in rows] == [x[:4] for x in want]
        size = len(aligner.b.bytes)
        assert Counter((p // size, p % size) for p, _ in keys) == linked
        found = Counter()
        for (p, _), n in zip(keys, links):
            found[p // size, p % size] += n
        assert found == total
        return
    table = docs(texts).repartition(3)
    documents, bitmaps = alignment.align_corpus(table, *paths)
    counts = alignment.pair_counts(bitmaps, alignment.size_of(paths[1]))
    assert {(x.a_id, x.b_id): (x.n_docs, x.n_links) for x in counts.collect()} == {p: (n, total[p]) for p, n in linked.items()}
    got = {x.doc_id: (x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum) for x in alignment.score_documents(documents, bitmaps, counts).collect()}
    assert got == dict(enumerate(want))


def test_groups_of_documents(spark, docs, paths):
    texts = [t for t in ODD if t] + ["naïve tokens, aligned"]
    for x in alignment.aligned_groups(docs(texts), *paths).collect():
        whole = (" " + texts[x.doc_id]).encode()
        assert [g.stop for g in x.groups][-1:] == ([len(whole)] if "▁" not in texts[x.doc_id] else [])
        spelt = vocabularies.ByteVocabulary(paths[0]).bytes if x.groups else []
        for g in x.groups:
            assert b"".join(spelt[i] for i in g.a_ids) == whole[g.start : g.stop]


def test_bitmaps():
    r = np.random.default_rng(1)
    for docs in (1, 7, 8, 300, 65536):
        pairs = np.sort(r.integers(0, 40, 4 * docs + 3))
        keys = np.unique(pairs * 65536 + r.integers(0, docs, len(pairs)))
        found, counts, bits = alignment._bitmaps(keys // 65536, keys % 65536, docs)
        again = [(p, x) for p, n, b in zip(found.tolist(), counts.tolist(), bits.to_pylist()) for x in alignment.places_of(b, n).tolist()]
        assert again == [(k // 65536, k % 65536) for k in keys.tolist()]
