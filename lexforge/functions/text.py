"""Text functions as column expressions.

White space, word and letter classes are those of Unicode throughout, hence (?U) in the patterns.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that the results depend on.
EXOTIC_SPACES = "   ﻿​"
EXOTIC_DASHES = "‐‑‒–—−"
KNOWN_GLYPHS = {"": " ", "": "•", "": "•", "": "-"}
SAME_WHEN_COMPARED = {"’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-"}
ORDINALS = "bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies|terdecies|quaterdecies|quindecies"
WRITTEN_ORDINALS = "pr[ée]liminaire|premi[eè]re?|unique"
LEVELS = ("partie", "livre", "titre", "chapitre", "section")
GREETINGS = "bonjour|bonsoir|salut|bjr|slt|hello|hi|coucou|bonne journee|bonne soiree|good morning|good evening"
THANKS = "merci|merci beaucoup|mrc|thanks|thank you|je vous remercie|c est note|parfait|super|ok merci"
IDENTITY = "qui es[- ]tu|qui etes[- ]vous|tu es qui|c est quoi ce site|que sais[- ]tu faire|que peux[- ]tu faire|tu sers a quoi|comment ca marche|aide|help"
COURTESY_WORDS = 6
PDF_WRITERS = "tcpdf|fpdf|itext|dompdf|wkhtmltopdf|pdfkit|reportlab"
NUMBER_LETTERS = "[LRDC]"


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition is a letter and marks, and those letters."""
    split = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: "".join(x for x in d if unicodedata.category(x) != "Mn") for c, d in split.items() if d != c}
    single = {c: p for c, p in plain.items() if len(p) == 1}
    return "".join(single), "".join(single.values())


_ACCENTED, _PLAIN = _accents()
_PLAIN_OF = str.maketrans(_ACCENTED, _PLAIN)


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def plain(text: str) -> str:
    """`without_accents` of a text at hand."""
    bare = text.translate(_PLAIN_OF)
    return bare if bare.isascii() else "".join(c for c in bare if unicodedata.category(c) != "Mn")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_line(c: Column) -> Column:
    """Exotic spaces and dashes in their plain forms, glyphs of symbol fonts as what they show, or a space. Idempotent."""
    glyphs, shown = "".join(KNOWN_GLYPHS), "".join(KNOWN_GLYPHS.values())
    plain = F.translate(c, EXOTIC_SPACES + EXOTIC_DASHES + glyphs, " " * len(EXOTIC_SPACES) + "-" * len(EXOTIC_DASHES) + shown)
    fixed = F.regexp_replace(plain, "[-]", " ")
    # all of these are U+00A0 or from U+2000 on: to look for such is quicker than to translate
    return F.when(c.rlike(r"[\xa0\u2000-\uffff]"), fixed).otherwise(c)


def comparison_form(c: Column) -> Column:
    """What two wordings are compared by: typography, accents, case and spacing aside."""
    same = F.translate(c, "".join(SAME_WHEN_COMPARED), "".join(SAME_WHEN_COMPARED.values()))
    return F.lower(collapsed(without_accents(same)))


def courtesy_form(c: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(without_accents(c)), r"(?U)[^\w\s!?.]", " "))


def courtesy_kind(c: Column) -> Column:
    """"greeting", "thanks" or "identity" if the whole message is only that; else null."""
    form = courtesy_form(c)
    short = (form != "") & (F.size(F.split(form, " ")) <= COURTESY_WORDS)
    is_one = lambda words: form.rlike(rf"^({words})[\s!.?]*$")
    return F.when(short, F.when(is_one(GREETINGS), "greeting").when(is_one(THANKS), "thanks").when(is_one(IDENTITY), "identity"))


_NUMBER = rf"(?:{NUMBER_LETTERS}[\s_]*)?\d+(?:\s*-\s*\d+)*(?:[\s_.]*[a-z]?(?:{ORDINALS}))*(?:\s*[A-Z](?=[.\-–:]))?"
_QUOTES = r"[«»\"'“”‘’\s]*"
ARTICLE_HEADER = rf"(?iuU)^{_QUOTES}(?:Article\s+({_NUMBER})\s*[.\-–:]?|Article\s+(premi[eè]re?)\s*[.\-–:]|Art\.?\s*({_NUMBER})\s*[.\-–]+)"
_LEVEL_NUMBER = rf"(?:{WRITTEN_ORDINALS}|[IVXLC|]+(?![A-Za-zÀ-ÿ])|\d+(?:\s*-\s*\d+)*)"
CONTENTS_LINE = r"(?U)\.{4,}\s*\d*\s*$"
PAGE_MARKER = r"^===PAGE (\d+)===\s*$"


def is_article_header(line: Column) -> Column:
    return line.rlike(ARTICLE_HEADER)


def article_number(line: Column) -> Column:
    """Canonical number of the article whose header a line starts with: null if it starts with none."""
    taken = lambda group: F.regexp_extract(line, ARTICLE_HEADER, group)
    raw = F.concat(taken(1), taken(3))
    # each ordinal after one space and in lower case: lower-case all, then give the book letter its case back
    spaced = F.regexp_replace(raw, rf"(?iuU)[\s_.]*[a-z]?({ORDINALS})", " $1")
    joined = F.regexp_replace(collapsed(spaced), r"\s*-\s*", "-")
    ordinals = reduce(lambda c, word: F.regexp_replace(c, rf"(?iu)(?<= ){word}\b", word), ORDINALS.split("|"), joined)
    booked = F.regexp_replace(ordinals, rf"^({NUMBER_LETTERS})[\s_]*(\d)", "$1 $2")
    return F.when(is_article_header(line), F.when(taken(2) != "", "1").otherwise(booked))


def header_rest(line: Column) -> Column:
    """What stands in a line after its article header."""
    return F.trim(F.regexp_replace(line, ARTICLE_HEADER, ""))


def level_pattern(level: str) -> str:
    return rf"(?iuU)^\s*{level}\s+({_LEVEL_NUMBER})\s*[:.\-]?\s*(.*)$"


def level_of(line: Column) -> Column:
    """The level, of LEVELS, whose header a line is; else null."""
    named = F.coalesce(*(F.when(line.rlike(level_pattern(level)), F.lit(level)) for level in LEVELS))
    return F.when(line.rlike(rf"(?iuU)^\s*(?:{'|'.join(LEVELS)})\s"), named)


def level_label(line: Column, level: str) -> Column:
    number, title = (F.regexp_extract(line, level_pattern(level), i) for i in (1, 2))
    written = number.rlike(rf"(?iu)^(?:{WRITTEN_ORDINALS})$")
    capital = F.concat(F.upper(F.left(number, F.lit(1))), F.lower(F.substring(number, 2, 100)))
    shown = F.when(written, capital).otherwise(F.translate(F.upper(number), "|", "I"))
    title = collapsed(title)
    return F.concat(F.lit(level.capitalize() + " "), shown, F.when(title != "", F.concat(F.lit(" - "), title)).otherwise(""))


def series_of(number: Column) -> Column:
    """The book letter of an article number, "" without one; null if the number cannot be read."""
    pattern = rf"(?iu)^\s*(?:({NUMBER_LETTERS})\s*)?(\d+)"
    return F.when(number.rlike(pattern), F.upper(F.regexp_extract(number, pattern, 1)))


def integer_of(number: Column) -> Column:
    pattern = rf"(?iu)^\s*(?:({NUMBER_LETTERS})\s*)?(\d+)"
    return F.when(number.rlike(pattern), F.regexp_extract(number, pattern, 2).cast("long"))


def is_repealed_text(c: Column) -> Column:
    return c.rlike(r"(?iuU)^\W*(?:\([^)]{0,20}\)\s*)?\W*(?:abrog|supprim|r[ée]serv)")


def repetition_key(line: Column) -> Column:
    """A line's form by which repeats on many pages are found: long lines lose their digits."""
    clean = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(clean) < 20, clean).otherwise(collapsed(F.regexp_replace(clean, r"(?U)\d+", "")))


def is_writer_signature(line: Column) -> Column:
    return line.rlike(rf"(?iuU)^\s*(?:powered by|generated by|created (?:with|by))\s+(?:{PDF_WRITERS})\b")


def is_noise_line(line: Column) -> Column:
    """A scanning artefact: some tell-tale sign, and no word of four letters."""
    return line.rlike(r"[#=~^{}\\|]") & ~line.rlike(r"[A-Za-zÀ-ÿ]{4,}")


def rate_pattern(percent: str) -> str:
    """Pattern by which a rate such as "17,5" stands in a text, and no rate that merely contains it."""
    whole, _, decimals = percent.replace(".", ",").partition(",")
    tail = rf"[.,]{decimals}(?!\d)" if decimals else r"(?![.,]?\d)"
    return rf"(?iuU)(?<![\d.,]){whole}{tail}\s*(?:%|pour\s*cent)"


_RATE = r"(?iuU)(?<![\d.,])(\d+(?:[.,]\d+)?)(?![.,]?\d)\s*(?:%|pour\s*cent)"


def stated_rates(c: Column) -> Column:
    """The rates that a text states, as written but with a point, each once; one rate is never part of another."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(_RATE), F.lit(1)), lambda x: F.translate(x, ",", ".")))


def amount_pattern(amount: int) -> str:
    """Pattern by which an amount stands in a text, however its digits are grouped."""
    return "(?U)" + r"[\s., ]*".join(str(amount))


_ITEM = r"(?:[:;]|\A)\s*[•▪·‐-―-]?\s*(\d+)\s*°\s*\)?\s*"


def numbered_items(c: Column) -> Column:
    """The items "n° …" of an enumeration, as array<struct<mark, label>>; a marker counts after : or ; or at the start only."""
    parts = F.split(F.regexp_replace(c, "(?Us)" + _ITEM, "\u0001$1\u0002"), "\u0001")
    marked = F.filter(parts, lambda p: p.contains("\u0002"))
    items = F.transform(marked, lambda p: F.struct(F.concat(F.substring_index(p, "\u0002", 1), F.lit("°")).alias("mark"), F.regexp_replace(collapsed(F.substring_index(p, "\u0002", -1)), r"[ ;.]+$", "").alias("label")))
    return F.filter(items, lambda x: x["label"] != "")


def leading_key(mark: Column) -> Column:
    """The number that a mark such as "[1°] …" starts with, else the trimmed mark."""
    number = F.regexp_extract(mark, r"(?U)^\s*\[?\s*(\d+)", 1)
    return F.when(number != "", number).otherwise(F.trim(mark))


def clean_first_name(c: Column) -> Column:
    """A first name with control characters and runs of spaces as one space; null if nothing is left or it is not a name."""
    clean = collapsed(F.regexp_replace(c, r"[\p{C}\p{Z}]", " "))
    return F.when(clean.rlike(r"^[\p{L}\p{No}\p{Nl}][\p{L}\p{No}\p{Nl} '’-]{0,39}$"), clean)


def initials(name: Column, email: Column) -> Column:
    source = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.substring_index(email, "@", 1))
    words = F.filter(F.split(source, r"[ .\-_]+"), lambda w: w != "")
    two = F.upper(F.concat(F.left(words[0], F.lit(1)), F.left(F.get(words, F.lit(1)), F.lit(1))))
    return F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.upper(F.left(words[0], F.lit(2)))).otherwise(two)


def phone_number(c: Column) -> Column:
    """A mobile number as 237 and nine digits; null if it is none."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    short = F.when(digits.startswith("00237"), F.substring(digits, 3, 100)).otherwise(digits)
    full = F.when((F.length(short) == 9) & short.startswith("6"), F.concat(F.lit("237"), short)).otherwise(short)
    return F.when(full.startswith("237") & (F.length(full) == 12), full)


def reference_key(acronym: Column, number: Column) -> Column:
    """"ACRONYM number"; null unless both are there, as a number alone stands in many texts."""
    return F.when((F.trim(acronym) != "") & (F.trim(number) != ""), F.concat_ws(" ", F.upper(F.trim(acronym)), F.trim(number)))


def expected_reference(written: Column) -> Column:
    """`reference_key` of a reference written as acronym, white space and number; null if it is ambiguous."""
    parts = F.split(F.regexp_replace(written, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", 2)
    return reference_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def xml_escaped(c: Column) -> Column:
    plain = F.regexp_replace(c, "[-]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def upper_first(c: Column) -> Column:
    clean = F.trim(c)
    return F.concat(F.upper(F.left(clean, F.lit(1))), F.substring(clean, 2, 1_000_000))


def grouped_digits(amount: Column) -> Column:
    """A whole amount with a space between groups of three digits."""
    return F.translate(F.format_number(amount, 0), ",", " ")


def excerpt(c: Column, length: int, mark: str = "") -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit(mark))).otherwise(c)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of two letters or digits or more, accents aside."""
    return F.array_distinct(F.filter(F.split(F.lower(without_accents(c)), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2))
