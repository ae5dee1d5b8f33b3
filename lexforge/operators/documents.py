"""From pages to lines to articles, and what is checked, compared and versioned on the way.

Line order is always explicit (doc_id, line_no), and every window is within a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from . import scans

# Thresholds of the checks and of header removal.
SHORTEST, LONGEST, WITHOUT_PATH, MOST_DEPTHS = 40, 12_000, 0.02, 3
LEAST_PAGES, EDGE_LINES, REPEAT_SHARE = 4, 3, 0.3
SCANNED_CHARS_PER_PAGE = 100
#: Places of a version's chunks that are numbered together.
PLACES = 10_000
#: Lines of a document that are read together; what a reader carries on from them is handed to the next ones.
BLOCK_LINES = 20_000


def numbered_lines(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, line_no (from 0) and line of every line of a text."""
    return df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def in_blocks(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no) with block, dealt out by document and block, so that a long document is many tasks' work."""
    return scans.in_blocks(lines, "doc_id", F.floor(F.col("line_no") / BLOCK_LINES))


def _paged(lines: DataFrame) -> DataFrame:
    marker = F.regexp_extract("line", T.PAGE_MARKER, 1)
    marked = scans.scanned(in_blocks(lines.withColumn("marker", marker)), "doc_id", "line_no", {"page_no": F.when(F.col("marker") != "", F.col("marker").cast("int"))})
    return marked.where(F.col("marker") == "").drop("marker").withColumn("page_no", F.coalesce("page_no", F.lit(0)))


def paged_lines(df: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no and line of texts with page markers; lines before the first marker are on page 0."""
    return _paged(numbered_lines(df)).select("doc_id", "page_no", "line_no", "line")


def assembled_text(pages: DataFrame) -> DataFrame:
    """doc_id and text, with a marker line before each page of pages(doc_id, page_no, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    shown = F.transform(ordered, lambda p: F.concat(F.lit("===PAGE "), p["page_no"], F.lit("===\n"), p["text"], F.lit("\n")))
    return pages.groupBy("doc_id").agg(F.array_join(shown, "").alias("text"))


def scanned_documents(pages: DataFrame) -> DataFrame:
    """doc_id and scanned: fewer than SCANNED_CHARS_PER_PAGE characters a page."""
    return pages.groupBy("doc_id").agg((F.sum(F.length(F.trim("text"))) < SCANNED_CHARS_PER_PAGE * F.count("*")).alias("scanned"))


def _with_edges(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, lines, and low and high: the places of the last of a page's first EDGE_LINES non-blank lines, and of the
    first of its last ones; null without any."""
    held = pages.select("doc_id", "page_no", F.split("text", "\n").alias("lines"))
    filled = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    held = held.withColumn("filled", filled)
    low, high = F.get("filled", F.least(F.lit(EDGE_LINES), F.size("filled")) - 1), F.get("filled", F.greatest(F.size("filled") - EDGE_LINES, F.lit(0)))
    return held.select("doc_id", "page_no", "lines", low.alias("low"), high.alias("high"))


def _is_edge(line: Column, line_no: Column) -> Column:
    return (F.trim(line) != "") & ((line_no <= F.col("low")) | (line_no >= F.col("high")))


def edge_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line and edge: whether it is among the first or last non-blank lines of its page."""
    lines = _with_edges(pages).select("doc_id", "page_no", "low", "high", F.posexplode("lines").alias("line_no", "line"))
    return lines.withColumn("edge", _is_edge(F.col("line"), F.col("line_no"))).drop("low", "high")


def repeated_edges(lines: DataFrame) -> DataFrame:
    """doc_id, key and n of edge lines that stand on enough pages of a document of LEAST_PAGES or more."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    keyed = lines.where("edge").select("doc_id", "page_no", T.repetition_key(F.col("line")).alias("key")).where("key <> ''").distinct()
    counts = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    # the share is taken in whole numbers, so that no rounding of 0.3 decides
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * int(REPEAT_SHARE * 10) / 10))
    return counts.join(pages, "doc_id").where(F.col("n") >= least).select("doc_id", "key", "n")


def repeated_keys(pages: DataFrame) -> DataFrame:
    """doc_id and keys, sorted, of `repeated_edges`: few a document, as each is that of many pages."""
    return kept(repeated_edges(edge_lines(pages)).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys")))


def without_repeated_edges(pages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pages(doc_id, page_no, text) less repeated edge lines and lines that PDF writers sign with. keys: their `repeated_keys`,
    where these are known."""
    held = _with_edges(pages).join(repeated_keys(pages) if keys is None else keys, "doc_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    gone = lambda line, i: _is_edge(line, i) & F.array_contains("keys", T.repetition_key(line))
    left = F.filter("lines", lambda line, i: ~gone(line, i) & ~T.is_writer_signature(line))
    return held.select("doc_id", "page_no", F.coalesce(F.array_join(left, "\n"), F.lit("")).alias("text"))


def without_noise_lines(pages: DataFrame) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda line: ~T.is_noise_line(line))
    return pages.withColumn("text", F.array_join(kept, "\n"))


def _noted(lines: DataFrame) -> DataFrame:
    """What lines(doc_id, line_no, line) say, read once before they are dealt out: marker (a page's number, else empty), listed
    (a line of a table of contents), level and label of a heading, number of an article header, and part, what is left of it."""
    held = lines.select("doc_id", "line_no", F.regexp_extract("line", T.PAGE_MARKER, 1).alias("marker"), T.clean_line(F.col("line")).alias("line"))
    held = held.withColumns({"listed": F.col("line").rlike(T.CONTENTS_LINE), "level": T.level_of(F.col("line"))})
    label = F.coalesce(*(F.when(F.col("level") == level, T.level_label(F.col("line"), level)) for level in T.LEVELS))
    held = held.withColumns({"label": label, "number": F.when(F.col("level").isNull(), T.article_number(F.col("line")))})
    return held.withColumn("part", F.when(F.col("number").isNotNull(), T.header_rest(F.col("line"))).otherwise(F.col("line"))).drop("line")


def _page() -> Column:
    return F.when(F.col("marker") != "", F.col("marker").cast("int"))


def _headings() -> dict[str, Column]:
    return {level: F.when(F.col("level") == level, F.struct(F.col("line_no").alias("at"), "label")) for level in T.LEVELS}


def _spanned(paged: DataFrame, first_page: int, last_page: int | None) -> DataFrame:
    span = F.coalesce("page_no", F.lit(0)).between(first_page, last_page if last_page is not None else 1 << 30)
    return paged.where((F.col("marker") == "") & span & ~F.col("listed"))


def _body(read: DataFrame) -> DataFrame:
    """The lines that belong to an article, with its path."""
    open_labels = []
    for i, level in enumerate(T.LEVELS):
        later = [F.coalesce(F.col(f"{x}.at"), F.lit(-1)) for x in T.LEVELS[:i]]
        above = reduce(F.greatest, later) if later else F.lit(-1)
        open_labels.append(F.when(F.col(f"{level}.at") > above, F.col(f"{level}.label")))
    return read.withColumn("path", F.concat_ws(" > ", *open_labels)).where((F.col("seq") > 0) & F.col("level").isNull())


def _head(c: str) -> Column:
    return F.min_by(c, "line_no").alias(c)


def _in_order(by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "part"))), lambda x: x["part"]), " ")


def articles(df: DataFrame, first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """doc_id, seq, number, path, content and page of the articles of texts with page markers.

    A text of at most BLOCK_LINES lines is one block, with nothing before it: its lines are dealt out by document, once, and read
    in order. Longer ones are read as `articles_of_lines` does."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    paged = _noted(numbered_lines(df.where(lines <= BLOCK_LINES))).withColumn("page_no", last(_page()))
    read = _spanned(paged, first_page, last_page).withColumns({level: last(c) for level, c in _headings().items()} | {"seq": F.count("number").over(so_far)})
    short = _body(read).groupBy("doc_id", "seq").agg(_head("number"), _head("path"), T.collapsed(_in_order("line_no")).alias("content"), F.min_by(F.coalesce("page_no", F.lit(0)), "line_no").alias("page"))
    long = kept(df.select("doc_id", "text").where(lines > BLOCK_LINES))  # few, and read several times
    return short.unionByName(articles_of_lines(numbered_lines(long), first_page, last_page))


def articles_of_lines(lines: DataFrame, first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """`articles` of lines(doc_id, line_no, line), as a reader of text files gives them.

    The state that a reader would carry from line to line, which is the page, the open headings and the open article, is
    the last of its kind so far; a heading closes those below it. Lines before the first article belong to none. An
    article's lines are joined block by block first."""
    paged = scans.scanned(in_blocks(_noted(lines)), "doc_id", "line_no", {"page_no": _page()})
    read = scans.scanned(_spanned(paged, first_page, last_page), "doc_id", "line_no", _headings(), {"seq": F.col("number")})
    parts = _body(read).groupBy("doc_id", "seq", "block").agg(F.min("line_no").alias("line_no"), _head("number"), _head("path"), F.min_by(F.coalesce("page_no", F.lit(0)), "line_no").alias("page_no"), _in_order("line_no").alias("part"))
    whole = parts.groupBy("doc_id", "seq").agg(_head("number"), _head("path"), T.collapsed(_in_order("block")).alias("content"), F.min_by("page_no", "line_no").alias("page"))
    return whole.select("doc_id", "seq", "number", "path", "content", "page")


#: Numbers that a problem shows.
SAMPLE = 20


def _smallest(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, and sample: the SAMPLE smallest values of rows, which are distinct. Tasks hand on no more than that of each."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(value))).where(F.col("__r") <= SAMPLE)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("sample"))


def problems(chunks: DataFrame) -> DataFrame:
    """doc_id, code, level ("blocking" or "warning"), n and sample (the SAMPLE smallest numbers, or missing ones) of the
    problems of articles(doc_id, number, path, content).

    One pass over the articles brings each number's down to a row; everything else is counted from those."""
    repealed, length, depth = T.is_repealed_text(F.col("content")), F.length("content"), F.size(F.split("path", " > "))
    numbers = chunks.groupBy("doc_id", "number").agg(
        F.count("*").alias("all"), F.count_if(T.series_of(F.col("number")).isNull()).alias("unreadable"), F.count_if(~repealed & (length < SHORTEST)).alias("short"),
        F.count_if(~repealed & (length > LONGEST)).alias("long"), F.count_if(repealed).alias("repealed"), F.count_if(F.trim("path") == "").alias("no_path"),
        F.collect_set(F.when(F.col("path") != "", depth)).alias("depths"),
    )
    twice = F.when(F.col("all") > 1, 1).otherwise(0)
    named = {"duplicate": twice, "unreadable": F.col("unreadable"), "short": F.col("short"), "long": F.col("long"), "repealed": F.col("repealed"), "no_path": F.col("no_path")}
    found = numbers.select("doc_id", "number", F.explode(F.array(*(F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in named.items()))).alias("f"))
    found = found.where("f.n > 0").select("doc_id", "f.code", "f.n", "number")
    counted = found.groupBy("doc_id", "code").agg(F.sum("n").alias("n"))
    shown = counted.join(_smallest(found.where("number IS NOT NULL"), ["doc_id", "code"], "number"), ["doc_id", "code"], "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
    sizes = numbers.groupBy("doc_id").agg(F.sum("all").alias("all"))
    few = (F.col("code") == "repealed") | ((F.col("code") == "no_path") & (F.col("n") <= WITHOUT_PATH * F.col("all")))
    listed = shown.join(sizes, "doc_id").select("doc_id", "code", F.when(few, "warning").otherwise("blocking").alias("level"), "n", "sample")
    deep = numbers.select("doc_id", F.explode("depths").alias("depth")).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_DEPTHS)
    deep = deep.select("doc_id", F.lit("depths").alias("code"), F.lit("warning").alias("level"), "n", F.array().cast("array<string>").alias("sample"))
    holes = series_gaps(numbers.select("doc_id", T.series_of(F.col("number")).alias("series"), T.integer_of(F.col("number")).alias("whole"))).withColumn("number", F.concat("series", F.col("missing").cast("string")))
    gaps = holes.groupBy("doc_id", "series").agg(F.count("*").alias("n")).join(_smallest(holes, ["doc_id", "series"], "number"), ["doc_id", "series"])
    return listed.unionByName(deep).unionByName(gaps.select("doc_id", F.lit("gap").alias("code"), F.lit("blocking").alias("level"), "n", "sample"))


def series_gaps(numbers: DataFrame) -> DataFrame:
    """doc_id, series and missing: the whole numbers strictly within numbers(doc_id, series, whole) that do not occur."""
    known = numbers.where("whole IS NOT NULL").select("doc_id", "series", "whole").distinct()
    after = F.lead("whole").over(Window.partitionBy("doc_id", "series").orderBy("whole"))
    holes = known.withColumn("next", after).where("next > whole + 1")
    return holes.select("doc_id", "series", F.explode(F.sequence(F.col("whole") + 1, F.col("next") - 1)).alias("missing"))


def may_load(chunks: DataFrame) -> DataFrame:
    """doc_id and loadable: whether no problem of the document blocks it."""
    blocked = problems(chunks).where("level = 'blocking'").select("doc_id").distinct().withColumn("blocked", F.lit(True))
    return chunks.select("doc_id").distinct().join(blocked, "doc_id", "left").select("doc_id", F.col("blocked").isNull().alias("loadable"))


def word_overlap(pairs: DataFrame) -> DataFrame:
    """pair_id and similarity of pairs(pair_id, left, right) by the words they share, repeats counted: 2 * common / all, 1 of none."""
    signed = F.explode(F.array(*(F.struct(F.col(name).alias("text"), F.lit(sign).alias("sign")) for name, sign in (("left", 0), ("right", 1)))))
    words = pairs.select("pair_id", signed.alias("s")).select("pair_id", "s.sign", F.explode(F.filter(F.split("s.text", " "), lambda w: w != "")).alias("word"))
    counts = words.groupBy("pair_id", "word").agg(F.count_if(F.col("sign") == 0).alias("n_left"), F.count_if(F.col("sign") == 1).alias("n_right"))
    sums = counts.groupBy("pair_id").agg(F.sum(F.least("n_left", "n_right")).alias("common"), F.sum(F.col("n_left") + F.col("n_right")).alias("all"))
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.coalesce(2.0 * F.col("common") / F.col("all"), F.lit(1.0)).alias("similarity"))


def compare_versions(deposited: DataFrame, in_force: DataFrame) -> DataFrame:
    """number, status, article_id, old, new, path and similarity of deposited(seq, number, path, content) against
    in_force(id, number, path, content): added, changed, unchanged or repealed. Of repeated numbers in force the last
    counts; each deposited one is compared."""
    base = in_force.groupBy("number").agg(F.max_by(F.struct("id", "content", "path"), "id").alias("b")).select("number", F.col("b.id").alias("article_id"), F.col("b.content").alias("old"), F.col("b.path").alias("old_path"))
    joined = deposited.select("seq", "number", F.col("path").alias("new_path"), F.col("content").alias("new")).join(base, "number", "full_outer")
    a, b = T.comparison_form(F.col("old")), T.comparison_form(F.col("new"))
    status = F.when(F.col("seq").isNull(), "repealed").when(F.col("article_id").isNull(), "added").when(a == b, "unchanged").otherwise("changed")
    same = joined.withColumn("status", status).withColumn("pair_id", F.struct("number", "seq"))
    scored = word_overlap(same.where("status = 'changed'").select("pair_id", a.alias("left"), b.alias("right")))
    value = F.when(F.col("status") == "unchanged", 1.0).when(F.col("status") == "changed", F.round("similarity", 3)).otherwise(0.0)
    return same.join(scored, "pair_id", "left").select("seq", "number", "status", "article_id", "old", "new", F.coalesce("new_path", "old_path").alias("path"), value.alias("similarity"))


def status_counts(diff: DataFrame, statuses: tuple[str, ...] = ("added", "changed", "repealed", "unchanged")) -> DataFrame:
    """One row with a count for each status, zero where there is none."""
    return diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def close_versions(all_articles: DataFrame, texts: DataFrame, text_id: int, chunks: DataFrame, on: Column) -> DataFrame:
    """all_articles after version text_id is validated: articles in force of the acronym's other versions end on its date,
    and its chunks(number, path, content) begin on it, with new ids after the largest."""
    own = texts.where(F.col("id") == text_id).select("acronym")
    others = texts.join(own, "acronym", "left_semi").where(F.col("id") != text_id).select(F.col("id").alias("text_id"), F.lit(True).alias("superseded"))
    closed = all_articles.join(others, "text_id", "left")
    closed = closed.withColumn("repealed_on", F.when(F.col("repealed_on").isNull() & F.col("superseded"), on).otherwise(F.col("repealed_on"))).drop("superseded")
    largest = all_articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("largest"))
    # ranks by blocks of places, and what stands before a block: no task sees all chunks
    block = F.floor(F.col("seq") / PLACES)
    sizes = chunks.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("seq"))
    fresh = chunks.withColumn("block", block).withColumn("within", within).join(before, "block").withColumn("rank", F.col("before") + F.col("within")).join(F.broadcast(largest))  # largest: one row
    new = fresh.select((F.col("largest") + F.col("rank")).cast("long").alias("id"), F.lit(text_id).cast("long").alias("text_id"), "number", "path", "content", on.alias("effective_on"), F.lit(None).cast("date").alias("repealed_on"))
    return closed.select(*new.columns).unionByName(new)


def embedding_text(acronym: Column, path: Column, number: Column, content: Column) -> Column:
    """What an article is embedded by: its place, then its content."""
    place = F.concat_ws(" > ", acronym, F.when(F.trim(path) != "", path), F.concat(F.lit("Article "), number))
    return F.concat(place, F.lit("\n"), content)


def missing_reviews(changed: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Numbers of changed(number, status) that must be read before validation and are not in reviewed(number)."""
    return changed.where("status <> 'unchanged'").select("number").distinct().join(reviewed.select("number"), "number", "left_anti")


def repaired(rows: DataFrame, column: str = "content") -> DataFrame:
    """The rows whose text cleaning changes, with the cleaned text."""
    fixed = T.clean_line(F.col(column))
    return rows.where(~(fixed.eqNullSafe(F.col(column)))).withColumn(column, fixed)


def repair_counts(rows: DataFrame, column: str = "content") -> DataFrame:
    """text_id, how many of its rows cleaning changes, and n."""
    changed = ~T.clean_line(F.col(column)).eqNullSafe(F.col(column))
    return rows.groupBy("text_id").agg(F.count_if(changed).alias("repaired"), F.count("*").alias("n"))
