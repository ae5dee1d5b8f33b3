"""Links against all pairs compared by Python sets."""

import random
import re

import numpy as np

from lexforge.llm import components
from lexforge.llm import near_duplicates as nd
from lexforge.llm import signature_tree as st
from lexforge.llm.components import connected_components


def brute(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab") + r.choice("cdefgh") + r.choice("ijklmnop") * r.randint(1, 3)
    passage = [word() for _ in range(40)]
    texts = []
    for base in range(12):
        own = [word() for _ in range(r.choice([3, 30, 200, 700, 1500]))]
        for _ in range(r.choice([1, 2, 6, 15])):
            w = list(own)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.4:
                w += passage
            texts.append(" ".join(x.upper() if r.random() < 0.05 else x for x in w))
    r.shuffle(texts)
    return list(enumerate(texts)) + [(900, None), (901, " \n"), (902, "one"), (903, "ONE"), (904, "one two")]


def test_components(spark, docs):
    for seed in (1, 2):
        texts = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs(texts)).collect()}
        assert got == brute(texts)


def test_words_that_repeat_within_shingles(spark, docs):
    """Texts of two or three words, whose shingles are the same few words in another order, and long words whose polynomials
    agree modulo 2 ** 64."""
    r = random.Random(7)
    texts = ["a b b b a", "b a b a b", "a b b b a b a b", " ".join(["a b"] * 6), "b a a a b b b a b a"]
    texts += [" ".join(r.choice(w) for _ in range(r.randint(4, 40))) for w in ("ab", "abc") for _ in range(60)]
    thue_morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    texts += [f"{thue_morse} tail", f"{thue_morse.translate(str.maketrans('ab', 'ba'))} tail"]
    texts = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nd.near_duplicates(docs(texts)).collect()}
    assert got == brute(texts)


def test_small_blocks_and_no_early_links(spark, docs, monkeypatch):
    """Blocks of a few rows, so that every path for large buckets is taken; no early links, so that the rest finds all."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "_early_links", lambda docs, *a: docs.sparkSession.createDataFrame([], "a long, b long"))
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs(texts)).collect()}
    assert got == brute(texts)


def test_groups_whose_nearest_pair_fails(spark, docs, monkeypatch):
    """Early links make groups of unlike sets, so that groups must be tested beyond the pair that looks nearest."""
    texts = corpus(4)
    first = {}
    for i, t in texts:
        first.setdefault(t.lower() if t else None, i)
    ids = [i for t, i in first.items() if t and len(t.split()) > 5]
    pairs = list(zip(ids[::2], ids[1::2]))
    early = docs(texts).sparkSession.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(nd, "_early_links", lambda *a: early)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs(texts)).collect()}
    label = {i: c for i, (_, c) in brute(texts).items()}
    joined = {c: c for c in label.values()}

    def find(c):
        while joined[c] != c:
            c = joined[c]
        return c

    for a, b in pairs:
        x, y = sorted((find(label[a]), find(label[b])))
        joined[y] = x
    assert got == {i: find(c) for i, c in label.items()}


def test_shared_boilerplate(spark, docs):
    """Sets that share over half of their shingles and are not linked bring about few pairs to be tested."""
    common = " ".join(f"common{i}" for i in range(120))
    texts = [common + " " + " ".join(f"own{k}x{i}" for i in range(24)) for k in range(3000)] + [f"other{i % 90} " * 3 for i in range(100)]
    tested = []
    from_pairs = nd._tested
    try:
        nd._tested = lambda docs, pairs, *a: (tested.append(pairs.count()), from_pairs(docs, pairs, *a))[1]
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs(texts)).collect()}
    finally:
        nd._tested = from_pairs
    assert got == {i: i for i in range(3000)} | {3000 + i: 3000 + i % 90 for i in range(100)}
    assert sum(tested) < 10_000


def test_repeated_ids(spark, docs):
    """One id over two texts is one node: its links are those of both."""
    text = lambda a, b: " ".join(f"word{i}" for i in range(a, b))
    texts = [(5, text(0, 100)), (5, text(500, 600)), (5, text(0, 100)), (3, text(2, 102)), (8, text(502, 602)), (9, text(900, 950))]
    got = {(r.doc_id, r.component_id) for r in nd.near_duplicates(docs(texts)).collect()}
    assert got == {(5, 3), (3, 3), (8, 3), (9, 9)}


def test_null_ids(spark, docs):
    """A null id beside copies and near copies, as the only link between two others, and groups without any id."""
    word = lambda i: f"word{i}"
    text = lambda a, b: " ".join(map(word, range(a, b)))
    texts = [(None, text(0, 100)), (None, text(0, 100).upper()), (5, text(0, 100)), (3, text(0, 100)), (8, text(0, 110)), (None, text(14, 114))]
    texts += [(20, text(500, 600)), (None, text(512, 612)), (21, text(524, 624))]  # 20 and 21 are linked by the row between them only
    texts += [(None, text(2000, 2100)), (None, text(2000, 2100)), (None, text(2000, 2105)), (None, None), (None, " "), (30, text(3000, 3050)), (31, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(docs(texts)).collect()]
    want = [(None, 96, 3), (None, 96, 3), (5, 96, 3), (3, 96, 3), (8, 106, 3), (None, 96, 3), (20, 96, 20), (None, 96, 20), (21, 96, 20)]
    want += [(None, 96, None), (None, 96, None), (None, 101, None), (None, 0, None), (None, 0, None), (30, 46, 30), (31, 0, 31)]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)
    kept = [(r.doc_id, r.text) for r in nd.first_of_each(docs(texts)).collect()]
    assert order(kept) == order([(3, text(0, 100)), (20, text(500, 600)), (None, text(2000, 2100)), (None, None), (None, " "), (30, text(3000, 3050)), (31, None)])


def test_tree_loses_no_pair():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = r.integers(0, 1 << 62, r.integers(1, 400), dtype=np.int64).astype(np.uint64)
        for _ in range(8):
            keep = base[r.random(len(base)) > r.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 1 << 62, max(1, len(base) // 20), dtype=np.int64).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (sizes[i] + sizes[j])}
    for bits in (64, 512):
        found = {(min(i, j), max(i, j)) for a, b in st.SignatureTree(sizes, st.bitmaps(sets, bits), 75).candidates() for i, j in zip(a.tolist(), b.tolist())}
        assert want <= found


def test_connected_components(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    for edges in (components.EDGES, 3):  # in one task's forest, and by rounds of stars
        monkeypatch.setattr(components, "EDGES", edges)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long").repartition(8)).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert connected_components(spark.createDataFrame([(7, 7), (None, 1)], "a long, b long")).isEmpty()
