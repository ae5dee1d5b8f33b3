import hashlib
import random

import numpy as np

from lexforge.llm import minimizers, substring_dedup
from lexforge.llm.suffix_array import permuted_common_prefixes, suffix_array


def brute(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_removals(spark, docs):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    line, base = text(230), text(900)
    texts = [text(50), "", None, base, base, text(120) + line + text(80), "a" * 400, "ab" * 150]
    texts += [text(r.randint(0, 200)) + line + text(r.randint(0, 200)) for _ in range(60)]
    for _ in range(25):
        t = list(base)
        t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [base[:99], base[:100], base[5:106] + line[:100] + base[400:520]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.removal_digests(docs(rows)).collect()}
    assert got == brute(rows, 100)


def test_ids_at_both_ends(spark, docs):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    line = text(180)
    rows = [(i, text(40) + line + text(40) + line) for i in (-(2**63), 1 - 2**63, -1, 0, 2**60, 2**63 - 2, 2**63 - 1)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.removal_digests(docs(rows)).collect()}
    assert got == brute(rows, 100)


def test_crowded_minimizers(spark, docs, monkeypatch):
    """Windows dealt out one by one give the same removals."""
    monkeypatch.setattr(substring_dedup, "MOST_RUNS", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    line = text(150)
    rows = [(i, text(r.randint(0, 90)) + line[r.randint(0, 30) :] + text(r.randint(0, 90))) for i in range(40)] + [(50, None), (51, line), (51, line)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.removal_digests(docs(rows)).collect()}
    want = brute([r for r in rows if r[0] < 51], 100)
    assert {k: v for k, v in got.items() if k < 51} == want


def test_texts_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(minimizers, "_BLOCK", 150)
    r = random.Random(2)
    half = "".join(r.choice("abcd") for _ in range(700))
    whole = [(0, half), (1, half[::-1] + half)]
    found = {i: [] for i, _ in whole}
    for i, t in whole:
        covered = []
        for _, first, n in minimizers.runs(t.encode(), 100, minimizers.frequency_table(np.zeros(0, np.uint64))):
            covered += [w for a, k in zip(first.tolist(), n.tolist()) for w in range(a, a + k)]
        assert covered == list(range(len(t) - 99))


def test_kept_texts(spark, docs):
    r = random.Random(3)
    line = "".join(r.choice("éàüöîçñ") for _ in range(70))
    table = docs([line, "start " + line + "é end", None, (None, line)]).selectExpr("*", "7L AS n_chars", "'clash' AS spans", "'clash' AS __spans", "'clash' AS stop", "'clash' AS key")
    out = substring_dedup.remove_repeats(table)
    assert out.columns == table.columns
    got = {r.doc_id: (r.text, r.n_chars, r.spans, r.key) for r in out.collect()}
    assert got[0] == (line, len(line), "clash", "clash") and got[1][:2] == ("start é end", 11) and got[2][0] is None and got[None][0] == line


def test_suffix_array_of_a_megabyte():
    """Names of substrings are sorted by induced sorting, level below level, however many they are."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    raw = "\n".join(t or "" for t in texts).encode()[:1_000_000]
    s, levels = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0), []
    sa = suffix_array(s, levels)
    assert len(levels) >= 4 and levels[0] > 100_000 and all(2 * b <= a + 1 for a, b in zip(levels, levels[1:]))
    assert len(np.unique(sa)) == len(s)
    padded = raw + b"\0"
    assert all(padded[a : a + 4000] <= padded[b : b + 4000] for a, b in zip(sa[:-1:7].tolist(), sa[1::7].tolist()))


def test_suffix_array():
    r = random.Random(5)
    for _ in range(300):
        s = np.array([r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))] + [0])
        l = s.tolist()
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(l)), key=lambda i: l[i:])
        common = permuted_common_prefixes(s, sa)
        for a, b in zip(sa, sa[1:]):
            k = 0
            while l[a + k] == l[b + k]:
                k += 1
            assert common[b] == k


def test_suffix_array_takes_steps_of_many_suffixes():
    """No level is scanned suffix by suffix: the lines run do not grow with the text."""
    import sys

    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    raw = " ".join(r.choice(words) for _ in range(20_000)).encode()
    s, levels, lines = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 2, 0), [], 0

    def trace(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return trace if "suffix_array" in frame.f_code.co_filename else None

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        sa = suffix_array(s, levels)
        common = permuted_common_prefixes(s, sa)
    finally:
        sys.settrace(before)
    assert len(levels) >= 2 and lines < 20_000
    padded = raw + b"\0"
    for a, b in zip(sa[:-1:11].tolist(), sa[1::11].tolist()):
        n = int(common[b])
        assert padded[a : a + n] == padded[b : b + n] and padded[a + n] < padded[b + n]


def test_suffix_array_of_regular_texts():
    """Long rows of one symbol, periods, and parts that fall or rise throughout."""
    fall = list(range(250, 200, -1))
    for x in ([7] * 700, [5, 6] * 300, [6, 5] * 300, fall * 12, fall[::-1] * 12, ([3] * 40 + [1]) * 15, ([3] * 40 + [4] * 40 + [1]) * 8, [9, 9, 8, 9, 9, 8, 8] * 80):
        s = np.array(x + [0])
        l, sa = s.tolist(), suffix_array(s)
        assert sa.tolist() == sorted(range(len(l)), key=lambda i: l[i:])
        common = permuted_common_prefixes(s, sa)
        for a, b in zip(sa.tolist(), sa[1:].tolist()):
            n = int(common[b])
            assert l[a : a + n] == l[b : b + n] and l[a + n] < l[b + n]
