"""Reading order of word boxes, and repair of words broken by hyphens.

The order of words depends on what came before on the same page, so that runs on one page's rows at a time; Spark
deals pages out. Hyphens are repaired by joins and running values over all lines.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from .documents import BLOCK_LINES

# Column detection and the words by which a doubtful hyphen is kept.
LEAST_WORDS, STEP, GUTTER, CENTRE, SIDE = 20, 2.0, 18.0, (0.35, 0.65), 0.2
LINE_TOLERANCE = 3.0
KEPT_AFTER = ["ci", "non", "main", "sous", "demi", "semi", "mi", "quasi", "ex", "vis", "au", "par", "contre", "avant", "apres", "nu", "grand", "celui", "celle", "ceux", "celles", "lui", "elle", "elles", "eux", "soi"]
KEPT_BEFORE = ["ci", "la", "meme", "memes", "même", "mêmes", "ce", "il", "ils", "elle", "elles", "on", "vous", "nous", "y", "dessus", "dessous", "apres", "après", "joint", "jointe", "contre", "delà", "dela"]


def _pages_of_words(words: DataFrame, *columns: str) -> DataFrame:
    """A row a page of words: doc_id, page_no, width, and words (x0, x1 and further columns)."""
    return words.groupBy("doc_id", "page_no").agg(F.max("width").alias("width"), F.collect_list(F.struct("x0", "x1", *columns)).alias("words"))


def _with_gutters(pages: DataFrame) -> DataFrame:
    """`_pages_of_words` with gutter. Each step goes on from columns of the one before, as a lambda would find anew for every
    element what it takes from outside."""
    low, high = F.col("width") * CENTRE[0], F.col("width") * CENTRE[1]
    most = F.floor((high - low) / STEP).cast("int")
    # the steps within each word, counted rather than compared
    first, last = (lambda w: F.ceil((w["x0"] - low) / STEP).cast("int")), (lambda w: F.floor((w["x1"] - low) / STEP).cast("int"))
    spans = F.transform("words", lambda w: F.struct(F.greatest(first(w), F.lit(0)).alias("a"), F.least(last(w), most).alias("b")))
    end = F.struct((most + 1).alias("a"), (most + 1).alias("b"))
    ordered = F.array_sort(F.concat(F.filter(spans, lambda s: s["a"] <= s["b"]), F.array(end)))
    start = F.struct(F.lit(0).alias("next"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("double").alias("right"))
    run = pages.withColumn("run", F.when(F.size("words") >= LEAST_WORDS, F.aggregate(ordered, start, lambda run, s: _wider(run, s, low))))
    middle = F.when(F.col("run.right") - F.col("run.left") >= GUTTER, (F.col("run.left") + F.col("run.right")) / 2)
    sides = lambda side: F.size(F.filter("words", side)) >= SIDE * F.size("words")
    good = sides(lambda w: w["x1"] <= middle) & sides(lambda w: w["x0"] >= middle)
    return run.withColumn("gutter", F.when(middle.isNotNull() & good, middle)).drop("run")


def _wider(run: Column, span: Column, low: Column) -> Column:
    """run: the first step beyond all spans so far, and the ends of the widest run of free steps, the first of several; spans
    come in order."""
    left, right = low + run["next"] * STEP, low + (span["a"] - 1) * STEP
    wider = (span["a"] > run["next"]) & (run["left"].isNull() | (right - left > run["right"] - run["left"]))
    ends = (F.when(wider, new).otherwise(run[c]).alias(c) for c, new in (("left", left), ("right", right)))
    return F.struct(F.greatest(run["next"], span["b"] + 1).alias("next"), *ends)


def gutters(words: DataFrame) -> DataFrame:
    """doc_id, page_no and gutter (its middle; null without one) of words(doc_id, page_no, x0, x1, top, text, width).

    Positions every STEP points of the central part of a page that no word crosses; the widest run of them divides two
    columns if it is wide enough and each side has its share of the words."""
    return _with_gutters(_pages_of_words(words)).select("doc_id", "page_no", "gutter")


def lines_of(words: list[tuple[int, float, float, str]], tolerance: float) -> list[str]:
    """The lines of a page's words (side, top, x0, text)."""
    out: list[str] = []
    line: list[tuple[float, str]] = []
    begun = None
    for side, top, x0, text in sorted(words, key=lambda w: (w[0], round(w[1], 1), w[2], w[1], w[3])):
        if begun is not None and (side != begun[0] or abs(begun[1] - top) > tolerance):
            out.append(" ".join(t for _, t in sorted(line)))
            line, begun = [], None
        begun = (side, top) if begun is None else begun
        line.append((x0, text))
    return [*out, " ".join(t for _, t in sorted(line))] if line else out


def page_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """doc_id, page_no, line_no and line of words in reading order, the left column before the right one.

    A word begins a line when it stands more than the tolerance below the line's first word. Words are brought together by
    page once; many pages are read in a batch."""
    pages = _with_gutters(_pages_of_words(words, "top", "text"))

    @F.pandas_udf("array<string>")
    def lines(gutters: pd.Series, tops: pd.Series, lefts: pd.Series, texts: pd.Series) -> pd.Series:
        # as floats of Python, which are rounded otherwise than numpy's; no x0 reaches a gutter that is null
        pages = zip(gutters, *(c.map(lambda x: x.tolist()) for c in (tops, lefts, texts)))
        return pd.Series([lines_of([(int(x0 >= gutter), top, x0, text) for top, x0, text in zip(*page)], tolerance) for gutter, *page in pages], dtype=object)

    return pages.select("doc_id", "page_no", F.posexplode(lines("gutter", *(f"words.{c}" for c in ("top", "x0", "text")))).alias("line_no", "line")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "line_no", "line")


# A word broken at a line's end, what goes on with it, a word broken within a line, a compound, and a whole word.
BROKEN = r"[A-Za-zÀ-ÿ]{2,}-$"
GOES_ON = r"^[a-zà-ÿ]+"
INLINE = r"([A-Za-zÀ-ÿ]{2,})- ([a-zà-ÿ]+)"
COMPOUND = r"[A-Za-zÀ-ÿ]+-[A-Za-zÀ-ÿ]+"
WHOLE = r"^[A-Za-zÀ-ÿ]{2,}$"
BETWEEN_WORDS = r"[^-\p{L}\p{N}_]+"
_TAIL, _BROKEN, _ONE_LETTER, _INLINE = re.compile("[A-Za-zÀ-ÿ]{2,}(?=-$)"), re.compile("[A-Za-zÀ-ÿ]{2}-"), re.compile("[a-zà-ÿ]-"), re.compile(INLINE)
_HEAD, _WORDS, _WHOLE, _COMPOUND = re.compile(GOES_ON), re.compile(r"[-\w]+"), re.compile(WHOLE), re.compile(COMPOUND)

Found = Collection[str]


def _union(left: str, right: str, found: Found) -> str:
    """Two halves as the document's own words have it: one word if that stands elsewhere, a compound if that does, or if
    either half is one that usually keeps its hyphen. found: the document's words among those that `halves` asks for."""
    one, two = (left + right).lower(), f"{left}-{right}".lower()
    compound = one not in found and (two in found or left.lower() in KEPT_AFTER or right.lower() in KEPT_BEFORE)
    return f"{left}-{right}" if compound else left + right


def _tail(text: str) -> re.Match | None:
    """The word before the hyphen that a text ends with."""
    return _TAIL.search(text, text.rfind(" ") + 1)


def halves(chain: list[str]) -> set[str]:
    """The words, whole and compound, that may have to be looked up to join the lines of a chain. A line that is but a piece of
    a word leaves two readings of what stands before the next one."""
    asked, ends = set(), {chain[0].rstrip()}
    for line in chain[1:]:
        rest, after = line.lstrip(), set()
        right = _HEAD.match(rest)[0]
        for text in ends:
            if tail := _tail(text):
                asked |= {(tail[0] + right).lower(), f"{tail[0]}-{right}".lower()}
                after |= {tail[0] + rest.rstrip(), f"-{rest.rstrip()}"}
            else:
                after.add(rest.rstrip())
        ends = {text if (tail := _tail(text)) is None else text[max(0, tail.start() - 1) :] for text in after}
    return asked


def joined_chain(chain: list[str], found: Found) -> tuple[list[str], int]:
    """The lines of a chain, each moved up behind the hyphen before it and leaving a blank line, and how many were."""
    out, at, n = list(chain), 0, 0
    before, end = [], chain[0]  # of the line that others are moved up to: what is settled, and the rest
    for k in range(1, len(chain)):
        rest, text = chain[k].lstrip(), end.rstrip()
        if tail := _tail(text):
            right = _HEAD.match(rest)[0]
            before.append(text[: tail.start()])
            end = _union(tail[0], right, found) + rest[len(right) :]
            out[k], n = "", n + 1
        else:
            out[at] = "".join(before) + end
            at, before, end = k, [], chain[k]
    out[at] = "".join(before) + end
    return out, n


def joined_inline(text: str, found: Found) -> str:
    return _INLINE.sub(lambda m: _union(m[1], m[2], found), text)


def _asked_inline(text: str) -> list[str]:
    return [w for a, b in _INLINE.findall(text) for w in ((a + b).lower(), f"{a}-{b}".lower())]


def own_words(text: str) -> set[str]:
    """The words of a text, whole and as compounds, that decide about its hyphens."""
    return {w.lower() for w in set(_WORDS.findall(text)) if _WHOLE.match(w)} | {w.lower() for w in _COMPOUND.findall(text)}


def _is_broken(line: str) -> bool:
    end = line.rstrip()
    return end.endswith("-") and bool(_BROKEN.fullmatch(end[-3:]) or _ONE_LETTER.fullmatch(end.lstrip()))


def _goes_on(line: str) -> bool:
    return _HEAD.match(line.lstrip()) is not None


def chains(lines: list[str]) -> list[list[int]]:
    """The places of the lines that are not blank, those together that each go on with a word broken before."""
    found: list[list[int]] = []
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        if found and _is_broken(lines[found[-1][-1]]) and _goes_on(line):
            found[-1].append(k)
        else:
            found.append([k])
    return found


def repair_pages(pages: list[str]) -> tuple[list[str], int]:
    """What `without_hyphens` makes of one document's pages, and the number of repairs."""
    found = own_words(" ".join(pages))
    places = [(p, k) for p, page in enumerate(pages) for k in range(page.count("\n") + 1)]
    lines, repairs = "\n".join(pages).split("\n"), 0
    for chain in chains(lines):
        moved, n = joined_chain([lines[k] for k in chain], found)
        repairs += n
        for k, line in zip(chain, moved):
            lines[k] = line
    repairs += sum(len(_INLINE.findall(t)) for t in lines)
    rows = [[joined_inline(t, found) for (q, _), t in zip(places, lines) if q == p] for p in range(len(pages))]
    return ["\n".join(r) for r in rows], repairs


@dataclass(frozen=True)
class Ends:
    """What of a part of a page may be joined to others of its document. head: the lines of its first chain, if that goes on;
    tail: those of its last one, if that is broken; through: whether these are all its lines. asked: words of its chains that
    it does not have itself."""

    filled: bool
    goes_on: bool
    broken: bool
    through: bool
    head: list[str] | None
    tail: list[str] | None
    asked: list[str]

    @classmethod
    def of(cls, text: str) -> Ends:
        lines = text.split("\n")
        if not (found := chains(lines)):
            return cls(False, False, False, False, None, None, [])
        goes_on, broken = _goes_on(lines[found[0][0]]), _is_broken(lines[found[-1][-1]])
        asked = set().union(*(halves([lines[k] for k in chain]) for chain in found if len(chain) > 1))
        head, tail = ([lines[k] for k in chain] for chain in (found[0], found[-1]))
        return cls(True, goes_on, broken, len(found) == 1, head if goes_on else None, tail if broken else None, sorted(asked - own_words(text)) if asked else [])


def repaired_part(text: str, found: Found, head: list[str] | None, tail: list[str] | None, alone: bool) -> tuple[str, int, list[str] | None, list[str] | None]:
    """A part of a page less its hyphens, and the number of repairs. found: what other parts of the document have of the words
    it asks for; head and tail: the lines of its first and last chain, where these are joined to other parts already. alone:
    whether the document has no other part; else, where others must be asked for words broken within a line, that is left
    undone, and the words that are known and those that are not come along."""
    lines, n, held = text.split("\n"), 0, own_words(text) | set(found) if "-" in text else set(found)
    places = chains(lines)
    for i, chain in enumerate(places):
        if i == 0 and head is not None:
            moved = head
        elif i == len(places) - 1 and tail is not None:
            moved = tail
        elif len(chain) > 1:
            moved, more = joined_chain([lines[k] for k in chain], held)
            n += more
        else:
            continue
        for k, line in zip(chain, moved):
            lines[k] = line
    text = "\n".join(lines)
    if "- " not in text:
        return text, n, None, None
    asked = set(_asked_inline(text))
    n += len(_INLINE.findall(text))
    if alone or asked <= held:
        return joined_inline(text, held), n, None, None
    return text, n, sorted(asked & held), sorted(asked - held)


def _known_words(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked(doc_id, id, word) whose word stands in the document, whole or as a compound, by id: id and found."""
    words = F.filter(F.split("text", BETWEEN_WORDS), lambda w: w.rlike(WHOLE))
    held = pages.select("doc_id", F.explode(F.array_distinct(F.transform(F.concat(words, F.regexp_extract_all("text", F.lit(COMPOUND), F.lit(0))), F.lower))).alias("word"))
    # only words that are asked for take part, so a document's others never leave their scan where those are few
    met = held.join(asked.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_semi").distinct()
    return asked.join(met, ["doc_id", "word"]).groupBy("doc_id", "id").agg(F.collect_set("word").alias("found"))


def _in_parts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, at (page_no and part), parts (of the page) and text of pages, cleaned, in parts of BLOCK_LINES lines."""
    text = F.coalesce(T.clean_line(F.col("text")), F.lit(""))
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / BLOCK_LINES).cast("int")), lambda i: F.array_join(F.slice(lines, i * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), "\n"))
    long = F.length("text") - F.length(F.replace("text", F.lit("\n"))) >= BLOCK_LINES
    held = pages.select("doc_id", "page_no", text.alias("text")).withColumn("cut", F.when(long, cut).otherwise(F.array("text")))
    parts = held.select("doc_id", "page_no", F.size("cut").alias("parts"), F.posexplode("cut").alias("part", "text"))
    return parts.select("doc_id", "page_no", F.struct("page_no", "part").alias("at"), "parts", "text")


_LINES = "array<string>"


def _joined_over_parts(ends: DataFrame) -> DataFrame:
    """doc_id, id (where it begins) and members (at, first, lines) of the chains that go over the ends of parts: as few as
    these, however many lines there are. first: whether a part's first chain is meant, or its last."""
    by = Window.partitionBy("doc_id").orderBy("at")
    linked, onward = F.col("goes_on") & F.lag("broken", 1, False).over(by), F.col("broken") & F.lead("goes_on", 1, False).over(by)
    held = ends.where("filled").select("doc_id", "at", "through", "head", "tail", linked.alias("linked"), onward.alias("onward")).withColumn("whole", F.col("through") & F.col("linked"))
    own = F.last(F.when(~F.col("whole"), F.col("at")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("own", own).withColumn("before", F.lag("own").over(by))
    firsts = held.where("linked").select("doc_id", F.col("before").alias("id"), F.struct("at", F.lit(True).alias("first"), F.col("head").alias("lines")).alias("m"))
    lasts = held.where("onward AND NOT whole").select("doc_id", F.col("at").alias("id"), F.struct("at", F.lit(False).alias("first"), F.col("tail").alias("lines")).alias("m"))
    return firsts.unionAll(lasts).groupBy("doc_id", "id").agg(F.array_sort(F.collect_list("m")).alias("members"))


def _from_other_parts(clean: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, at, found, head and tail, as `repaired_part` takes them, of every part of the documents of several(doc_id), and
    doc_id and n of the repairs over the ends of parts."""

    @F.pandas_udf(f"filled boolean, goes_on boolean, broken boolean, through boolean, head {_LINES}, tail {_LINES}, asked {_LINES}")
    def ends_of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(Ends.of(t)) for t in texts], columns=[f.name for f in fields(Ends)])

    @F.pandas_udf(_LINES)
    def asked_of(members: pd.Series) -> pd.Series:
        return members.map(lambda pieces: sorted(halves([line for piece in pieces for line in piece])))

    @F.pandas_udf(f"lines array<{_LINES}>, n long")
    def moved(members: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for pieces, words in zip(members, found):
            lines, n = joined_chain([line for piece in pieces for line in piece], frozenset(words))
            rest = iter(lines)
            rows.append(([[next(rest) for _ in piece] for piece in pieces], n))
        return pd.DataFrame(rows, columns=["lines", "n"])

    ends = kept(clean.join(several, "doc_id", "left_semi").select("doc_id", "at", ends_of("text").alias("e")).select("doc_id", "at", "e.*"))
    over = kept(_joined_over_parts(ends))
    asked = over.select("doc_id", F.struct(F.lit(True).alias("over"), F.col("id").alias("at")).alias("id"), F.explode(asked_of("members.lines")).alias("word"))
    asked = kept(asked.unionAll(ends.select("doc_id", F.struct(F.lit(False).alias("over"), "at").alias("id"), F.explode("asked").alias("word"))))
    known = kept(_known_words(clean, asked))
    of = lambda over, name: known.where(F.col("id.over") == over).select("doc_id", F.col("id.at").alias(name), "found")
    decided = over.join(of(True, "id"), ["doc_id", "id"], "left").withColumn("moved", moved("members.lines", F.coalesce("found", F.array().cast(_LINES))))
    decided = kept(decided.select("doc_id", F.col("moved.n").alias("n"), F.arrays_zip(F.col("members").alias("m"), F.col("moved.lines").alias("lines")).alias("xs")))
    pieces = decided.select("doc_id", F.explode("xs").alias("x")).select("doc_id", F.col("x.m.at").alias("at"), F.col("x.m.first").alias("first"), F.col("x.lines").alias("lines"))
    sides = pieces.groupBy("doc_id", "at").agg(F.max(F.when(F.col("first"), F.col("lines"))).alias("head"), F.max(F.when(~F.col("first"), F.col("lines"))).alias("tail"))
    given = ends.select("doc_id", "at", F.lit(False).alias("alone")).join(of(False, "at"), ["doc_id", "at"], "left").join(sides, ["doc_id", "at"], "left")
    return given, decided.select("doc_id", "n")


def without_hyphens(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, text and repairs (of the document) of pages(doc_id, page_no, text), cleaned, with words that end in a
    hyphen joined to what follows, over page ends too.

    Lines that each go on with a broken word form chains; the line that follows moves up whole and leaves a blank one. A page,
    or a part of BLOCK_LINES lines of a longer one, is read as it is, so lines never become rows. Of a document in several
    parts only the chains that go over their ends, and the words that a part asks for and does not have itself, are joined, so
    no task holds a document; a chain is in the end one line."""
    clean = kept(_in_parts(pages))
    several = kept(clean.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    many = not several.isEmpty()
    given, over = _from_other_parts(clean, several) if many else (None, None)
    held = clean.join(given, ["doc_id", "at"], "left") if many else clean.withColumns({"alone": F.lit(True), **{c: F.lit(None).cast(_LINES) for c in ("found", "head", "tail")}})

    @F.pandas_udf(f"text string, n int, held {_LINES}, missing {_LINES}")
    def repaired(texts: pd.Series, found: pd.Series, heads: pd.Series, tails: pd.Series, alone: pd.Series) -> pd.DataFrame:
        listed = lambda x: None if x is None else list(x)
        rows = [repaired_part(t, f, listed(a), listed(b), bool(c)) for t, f, a, b, c in zip(texts, found, heads, tails, alone)]
        return pd.DataFrame(rows, columns=["text", "n", "held", "missing"])

    call = repaired("text", F.coalesce("found", F.array().cast(_LINES)), "head", "tail", F.coalesce("alone", F.lit(True)))
    texts = kept(held.select("doc_id", "page_no", "at", "parts", F.col("alone").isNull().alias("single") if many else F.lit(True).alias("single"), call.alias("r")).select("doc_id", "page_no", "at", "parts", "single", "r.*"))
    columns = ["doc_id", "page_no", "at", "parts", "text", "n"]
    done = texts.where("single").select(*columns)
    if many:
        undone = texts.where("missing IS NOT NULL")
        words = _known_words(clean, undone.select("doc_id", F.col("at").alias("id"), F.explode("missing").alias("word"))).select("doc_id", F.col("id").alias("at"), "found")
        mend = F.pandas_udf(lambda lines, found: pd.Series([joined_inline(t, frozenset(f)) for t, f in zip(lines, found)], dtype=object), "string")
        mended = undone.join(words, ["doc_id", "at"], "left").withColumn("text", mend("text", F.concat("held", F.coalesce("found", F.array().cast(_LINES)))))
        rest = texts.where("NOT single AND missing IS NULL").select(*columns).unionAll(mended.select(*columns))
        counts = texts.where("NOT single").select("doc_id", F.col("n").cast("long").alias("n")).unionAll(over).groupBy("doc_id").agg(F.sum("n").cast("int").alias("n"))
        done = done.unionAll(rest.drop("n").join(counts, "doc_id").select(*columns))
    whole = done.where("parts = 1").select("doc_id", "page_no", "text", F.col("n").alias("repairs"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    longer = done.where("parts > 1").groupBy("doc_id", "page_no").agg(F.array_join(in_order, "\n").alias("text"), F.max("n").alias("repairs"))
    return whole.unionAll(longer)


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """Headers and footers go before hyphens are looked at, or a footer would stand between a word's halves."""
    from .documents import without_repeated_edges

    return without_hyphens(without_repeated_edges(pages))


# Repeated lines that the diagnostics of cleaning show, and their characters in a warning.
SHOWN_LINES, WARNED_LINES, WARNED_CHARS = 10, 3, 150


def cleaning_diagnostics(pages: DataFrame) -> DataFrame:
    """doc_id, removed (the first repeated lines by which headers and footers were told, sorted) and repairs of
    pages(doc_id, page_no, text)."""
    from .documents import repeated_keys, without_repeated_edges

    keys = repeated_keys(pages)
    removed = keys.select("doc_id", F.slice("keys", 1, SHOWN_LINES).alias("removed"))
    repaired = without_hyphens(without_repeated_edges(pages, keys)).groupBy("doc_id").agg(F.max("repairs").alias("repairs"))
    return repaired.join(removed, "doc_id", "left").select("doc_id", F.coalesce("removed", F.array().cast("array<string>")).alias("removed"), "repairs")


def arrival_warnings(diagnostics: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, position, code and shown of what a reviewer is told before the problems of articles: headers and footers that
    were removed come first, then pages in two columns. columns: as `gutters` gives them."""
    two = columns.groupBy("doc_id").agg(F.count("gutter").alias("two"), F.count("*").alias("pages")).where("two > 0")
    lines = F.left(F.array_join(F.slice("removed", 1, WARNED_LINES), " | "), F.lit(WARNED_CHARS))
    headers = diagnostics.where(F.size("removed") > 0).select("doc_id", F.lit(0).alias("position"), F.lit("headers_removed").alias("code"), lines.alias("shown"))
    return headers.unionByName(two.select("doc_id", F.lit(1).alias("position"), F.lit("two_columns").alias("code"), F.concat_ws("/", "two", "pages").alias("shown")))


def simulated_vector(content: Column, dims: int) -> Column:
    """A unit vector that depends on nothing but the text: chained SHA-256 digests read as 32-bit numbers."""
    import hashlib
    import struct

    def vector(text: str) -> list[float]:
        digest, numbers = hashlib.sha256(text.encode()).digest(), []
        while len(numbers) < dims:
            numbers += [n / 2**32 - 0.5 for n in struct.unpack("<8I", digest)]
            digest = hashlib.sha256(digest).digest()
        numbers = numbers[:dims]
        norm = sum(n * n for n in numbers) ** 0.5 or 1.0
        return [n / norm for n in numbers]

    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else vector(t)), "array<double>")(content)
