import random
import re

import pytest

from lexforge.operators import layout


def sequential(pages):
    """The rule as it is stated, line after line over a whole document."""
    letters, text = "A-Za-zÀ-ÿ", " ".join(pages)
    whole = {w.lower() for w in re.findall(rf"(?<![-\w])[{letters}]{{2,}}(?![-\w])", text)}
    compound = {w.lower() for w in re.findall(rf"[{letters}]+-[{letters}]+", text)}

    def union(a, b):
        if (a + b).lower() in whole:
            return a + b
        keep = f"{a}-{b}".lower() in compound or a.lower() in layout.KEPT_AFTER or b.lower() in layout.KEPT_BEFORE
        return f"{a}-{b}" if keep else a + b

    lines = [(p, line) for p, page in enumerate(pages) for line in page.split("\n")]
    rows, n, i = [t for _, t in lines], 0, 0
    while i < len(rows):
        j = next((k for k in range(i + 1, len(rows)) if rows[k].strip()), None)
        end = re.search(rf"([{letters}]{{2,}})-$", rows[i].rstrip())
        start = j is not None and re.match(r"([a-zà-ÿ]+)(.*)$", rows[j].lstrip(), re.S)
        if not (end and start):
            i += 1
            continue
        rows[i] = rows[i].rstrip()[: end.start()] + union(end[1], start[1]) + start[2]
        rows[j], n = "", n + 1
    for i, t in enumerate(rows):
        rows[i], k = re.subn(rf"([{letters}]{{2,}})- ([a-zà-ÿ]+)", lambda m: union(m[1], m[2]), t)
        n += k
    return ["\n".join(t for (q, _), t in zip(lines, rows) if q == p) for p in range(len(pages))], n


def documents(r, n):
    pieces = ["juge", "com", "mis", "saire", "ci", "dessus", "é", "a", "commissaire", "Juge", "juge-commissaire", "commis", "x1", "sous", "tous"]
    ends = ["-", "-", "- ", "", ".", "-\n", "-\n", "\n", "-  \n \n", " ", " ", " - "]
    return [["".join(r.choice(pieces) + r.choice(ends) for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 4))] for _ in range(n)]


def test_chains_against_the_sequential_rule():
    r = random.Random(1)
    for pages in documents(r, 4000):
        assert layout.repair_pages(pages) == sequential(pages), pages


@pytest.mark.parametrize("block", [2, 20_000])
def test_plan_against_the_sequential_rule(spark, monkeypatch, block):
    monkeypatch.setattr(layout, "BLOCK_LINES", block)
    r = random.Random(block)
    docs = documents(r, 150)
    rows = [(d, p, text) for d, pages in enumerate(docs) for p, text in enumerate(pages)] + [(900, 1, None), (901, 1, "")]
    got = {(x.doc_id, x.page_no): (x.text, x.repairs) for x in layout.without_hyphens(spark.createDataFrame(rows, "doc_id long, page_no int, text string")).collect()}
    want = {(900, 1): ("", 0), (901, 1): ("", 0)}
    for d, pages in enumerate(docs):
        texts, n = sequential(pages)
        want |= {(d, p): (t, n) for p, t in enumerate(texts)}
    assert got == want and sum(n for _, n in want.values()) > 100


def test_lines_never_become_rows(spark, monkeypatch):
    """What is kept between jobs is rows of pages, of few chains over their ends, and of words asked of other pages."""
    text = "\n".join(f"le com-\nmis{i % 7}saire dit ci- dessus" for i in range(2000))
    pages = spark.createDataFrame([(d, p, text) for d, n in ((1, 1), (2, 3), (3, 1)) for p in range(n)], "doc_id long, page_no int, text string")
    rows, kept = [], layout.kept
    monkeypatch.setattr(layout, "kept", lambda df: (made := kept(df), rows.append(made.count()))[0])
    found = layout.without_hyphens(pages).collect()
    assert {(x.doc_id, x.repairs) for x in found} == {(1, 4000), (2, 12_000), (3, 4000)} and len(found) == 5
    assert max(rows) <= 20
