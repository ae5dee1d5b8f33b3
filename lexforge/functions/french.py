"""Search terms of French texts: words without accents, less stop words, brought down to stems."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain, without_accents

# Words that no search asks for, without accents, and endings that a stem of three letters or more loses.
STOP_WORDS = (
    "ai aie ait alors as au aucun aussi autre aux avait avec avez avoir avons car ce ceci cela celle celles celui ces cet cette ceux chaque chez comme comment "
    "dans de des donc dont du elle elles en encore entre es est et etaient etait etant ete etes etre eu eux fait faire fut ici il ils je jusque la le les leur leurs lors lorsque lui "
    "ma mais me meme memes mes moi moins mon ne ni nos notre nous on ont ou par pas peu peut plus pour pourquoi puis quand que quel quelle quelles quels qui quoi sa sans se selon sera ses si soit "
    "son sont sous sur ta te tel telle tes toi ton tous tout toute toutes tu un une vos votre vous"
)
ENDINGS = (
    "e es ee ees s x er ers ez al ale ales aux el elle elles ement ements ment ments issement issements ation ations ateur ateurs atrice atrices ition itions ution utions "
    "ence ences ance ances isme ismes iste istes able ables ible ibles ique iques if ifs ive ives eur eurs euse euses eux ite ites age ages ant ants ante antes"
)
#: The shortest stem of three letters or more before an ending, as RE2 reads it; and the same of a word turned round, where the
#: longest ending comes first and is looked for at one place only.
STEM_PATTERN = f"^([a-z0-9]{{3,}}?)(?:{'|'.join(ENDINGS.split())})$"
_TURNED = f"^(?:{'|'.join(sorted((e[::-1] for e in ENDINGS.split()), key=lambda e: (-len(e), e)))})(?=.{{3}})"
WORD_BREAK = "[^a-z0-9]+"


def stem(word: Column) -> Column:
    """A word of plain small letters less its longest known ending."""
    return F.reverse(F.regexp_replace(F.reverse(word), _TURNED, ""))


def terms(c: Column) -> Column:
    """Stems of the words of two letters or digits or more that are no stop words, in order, repeats kept; null of null."""
    words = F.filter(F.split(F.lower(without_accents(c)), WORD_BREAK), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS.split()))
    return F.transform(words, stem)


_STOPPED, _BREAK, _ENDING = frozenset(STOP_WORDS.split()), re.compile(WORD_BREAK), re.compile(_TURNED)
#: Bytes of UTF-8 with the ASCII ones that part words as spaces, and capitals as small letters.
SPACED = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str) -> list[str]:
    """`terms` of a text at hand. A text's are those of the pieces that `SPACED` parts it into, one after the other."""
    words = (w for w in _BREAK.split(plain(text).lower()) if len(w) >= 2 and w not in _STOPPED)
    return [_ENDING.sub("", w[::-1])[::-1] for w in words]


def terms_sql(c: str) -> str:
    """`terms` of an SQL expression, in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
    words = f"list_filter(string_split_regex(lower(strip_accents({c})), '{WORD_BREAK}'), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"
    return f"list_transform({words}, lambda w: regexp_replace(w, '{STEM_PATTERN}', '\\1'))"
