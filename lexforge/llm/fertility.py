"""Quality rules: what public vocabularies make of a text's words, beside counts of words and lines.

Each word is encoded by itself, as it stands after a space, by a byte-level vocabulary and by a vocabulary of
pieces with byte fallback. A text's fertility is its characters per token under each; further measures are the
share of tokens that are fallen-back bytes, and the entropy of its pieces in bits. Texts whose measures leave
the band of their script are rejected; a script that has no band is judged by that of "OTHER". The script is that of most letters. Words
repeat, so a task remembers what became of them.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. The base
rules fail texts of fewer than LEAST_WORDS words, and those where more than MOST_REPEATED of all words lie in
windows of five words that stand again in the text. Null texts count as empty. Each row is judged by its own
text, whole and without a shuffle: repeated rows stay repeated. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, MEMO_ENTRIES, map_batches
from .vocabularies import ByteVocabulary, PieceVocabulary

LEAST_WORDS, MOST_REPEATED = 10, 0.20
_SYMBOLS = b"#*$%&|<>"
#: Words of a window that counts as repeated.
_WINDOW = 5
#: Bytes of texts whose new words are encoded together.
LEARN_BYTES = 1_000_000
#: Tokens at which a text is expected to reach its band's entropy; shorter ones, the same share of what their length allows.
ENTROPY_TOKENS = 1024


class Band(NamedTuple):
    """Characters per token of the byte-level vocabulary and of the pieces, from and to; the most fallen-back bytes among
    tokens; the least entropy."""

    least_a: float
    most_a: float
    least_b: float
    most_b: float
    most_fallback: float
    least_entropy: float


#: Bands by script, as Unicode names it. Prose of a script that the vocabularies know well has more characters to a token.
BANDS = {
    "LATIN": Band(1.2, 9, 1.1, 9, 0.15, 5.0), "CYRILLIC": Band(0.7, 7, 1.2, 7, 0.15, 4.0), "GREEK": Band(0.45, 5, 0.5, 5, 0.30, 3.5), "ARABIC": Band(0.4, 5, 0.4, 5, 0.50, 3.5),
    "HEBREW": Band(0.4, 5, 0.4, 5, 0.50, 3.5), "CJK": Band(0.25, 4, 0.25, 4, 0.90, 3.5), "HIRAGANA": Band(0.25, 4, 0.25, 4, 0.90, 3.5), "KATAKANA": Band(0.25, 4, 0.25, 4, 0.90, 3.5),
    "HANGUL": Band(0.2, 4, 0.2, 4, 0.95, 3.5), "OTHER": Band(0.15, 9, 0.15, 9, 1.0, 3.0),
}


class _Scripts(dict):
    """The script of every character met, "" of those that are no letters."""

    def __missing__(self, c: str) -> str:
        self[c] = script = unicodedata.name(c, "OTHER").split()[0] if c.isalpha() else ""
        return script


_SCRIPTS = _Scripts()


def _script_of(word: str) -> tuple[str, int]:
    """The script of most letters of a word, the first by name among equals, and how many they are."""
    if word.isascii():
        return "LATIN", len(word) if word.isalpha() else sum(map(str.isalpha, word))
    of = list(map(_SCRIPTS.__getitem__, word))
    names = set(of) - {""}
    n, name = min(((-of.count(name), name) for name in names), default=(0, "LATIN"))
    return name, -n


class Meter:
    """Measures texts by both vocabularies and remembers words."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        self.scripts: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        #: of every word: tokens of A and of B, fallen-back bytes, bytes, number of its script, letters
        self.table = np.zeros((0, 6), np.int64)
        self.cuts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        _, n_a = self.a.encode([" " + t for t in texts])
        ids, n_b = self.b.encode(texts)
        fallen = np.bincount(np.repeat(np.arange(len(words)), n_b), self.b.fallback[ids], minlength=len(words)).astype(np.int64)
        scripts = [_script_of(t) for t in texts]
        numbers = [self.scripts.setdefault(s, len(self.scripts)) for s, _ in scripts]
        self.table = np.concatenate([self.table, np.stack([n_a, n_b, fallen, np.array([len(w) for w in words], np.int64), np.array(numbers, np.int64), np.array([n for _, n in scripts], np.int64)], axis=1)])
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words))))
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(n_b)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def measure(self, texts: list[bytes]) -> Iterator[tuple]:
        """Of every text: words, bytes of words, words in repeated windows, tokens of A and of B, fallen-back bytes, entropy,
        script."""
        at = 0
        while at < len(texts):
            word_lists, size = [], 0
            while at < len(texts) and (not word_lists or size + len(texts[at]) <= LEARN_BYTES):
                size += len(texts[at])
                word_lists.append(texts[at].split())  # bytes are split at the six blanks of ASCII
                at += 1
            if len(self.places) > MEMO_ENTRIES or len(self.ids) > 20 * MEMO_ENTRIES:
                self._forget()
            known = len(self.places)
            new = set().union(*word_lists).difference(self.places)
            long = [w for w in new if len(w) > MEMO_CHARS]
            if new:
                self.learn([*new.difference(long), *long])  # those that are not remembered come last
            names = list(self.scripts)
            for words in word_lists:
                yield self._measured(words, names)
            if long:
                kept = known + len(new) - len(long)
                for w in long:
                    del self.places[w]
                self.table, self.cuts, self.ids = self.table[:kept], self.cuts[: kept + 1], self.ids[: self.cuts[kept]]

    def _measured(self, words: list[bytes], names: list[str]) -> tuple:
        if not words:
            return 0, 0, 0, 0, 0, 0, 0.0, "OTHER"
        numbers = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        place, times = np.unique(numbers, return_counts=True)
        rows = self.table[place]
        n_a, n_b, fallen, size = (times @ rows[:, :4]).tolist()
        letters = np.bincount(rows[:, 4], rows[:, 5] * times, minlength=len(names))
        script = min((-n, name) for n, name in zip(letters.tolist(), names))[1] if letters.any() else "OTHER"
        counts = self.cuts[place + 1] - self.cuts[place]
        ids = self.ids[np.repeat(self.cuts[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        shares = np.bincount(ids, np.repeat(times, counts))
        shares = shares[shares > 0] / max(n_b, 1)
        again = repeated_words(numbers) if len(place) < len(words) else 0
        return len(words), size, again, n_a, n_b, fallen, float(-(shares * np.log2(shares)).sum()) + 0.0, script


@cache
def meter_of(path_a: str, path_b: str) -> Meter:
    """One for each two vocabularies in a worker, so that tasks that follow one another share what it remembers."""
    return Meter(path_a, path_b)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words, given by numbers, in windows of five that stand twice or more, the first time included."""
    n = len(numbers) - _WINDOW + 1
    if n < 2:
        return 0
    spread = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    spread ^= spread >> np.uint64(32)
    hashes = sum(spread[k : k + n] * _FACTORS[k] for k in range(_WINDOW))
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    same = hashes[a] == hashes[b]
    if not same.any():
        return 0
    a, b = a[same], b[same]
    again = np.zeros(n, bool)
    if all((numbers[a + k] == numbers[b + k]).all() for k in range(_WINDOW)):
        again[a] = again[b] = True
    else:  # different windows share a hash
        windows = list(zip(*(numbers[k : k + n].tolist() for k in range(_WINDOW))))
        counts = Counter(windows)
        again[:] = [counts[w] > 1 for w in windows]
    edges = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(again)
    edges[at] += 1
    edges[at + _WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_a long, n_b long, n_fallback long, entropy double, script string"


def measure(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id; n_words, word_chars (characters of words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word that equal
    an earlier one), n_repeat_words (words in windows of five words that stand twice or more); n_a and n_b (tokens of the
    words under each vocabulary), n_fallback (tokens of B that are bytes), entropy (of tokens of B, in bits) and script, of
    every row of docs(doc_id, text)."""

    def make():
        meter = meter_of(path_a, path_b)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            chars = pc.fill_null(pc.utf8_length(batch.column(1).cast(pa.string())), 0).to_pylist()
            rows = []
            for text, n_chars, (n, size, again, *measured) in zip(texts, chars, meter.measure(texts)):
                symbols = len(text) - len(text.translate(None, _SYMBOLS))
                rows.append((n, n_chars - (len(text) - size), symbols, repeated_lines(text), again, *measured))
            names, kinds = zip(*(c.split() for c in _MEASURES.split(", ")))
            of = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            columns = [pa.array(c, of[k]) for c, k in zip(zip(*rows) if rows else ([],) * len(names), kinds)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

        return one

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(columns, make, f"doc_id long, {_MEASURES}")


def judge(measured: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Rows of `measure` with base_failed, chars_per_a and chars_per_b (characters per token), fallback_share, reason (the
    first measure that leaves the band of the script, null if none does) and kept."""
    band = F.create_map(*(x for name, b in sorted(bands.items()) for x in (F.lit(name), F.struct(*(F.lit(float(v)).alias(c) for c, v in b._asdict().items())))))
    chars = F.col("word_chars").cast("double")
    known = measured.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words")),
        "chars_per_a": F.try_divide(chars, "n_a"), "chars_per_b": F.try_divide(chars, "n_b"), "fallback_share": F.try_divide("n_fallback", "n_b"),
        "__band": F.coalesce(band[F.col("script")], band["OTHER"]),
    })
    b = lambda c: F.col("__band")[c]
    reachable = b("least_entropy") * F.least(F.lit(1.0), F.log2(F.greatest("n_b", F.lit(1)).cast("double")) / float(np.log2(ENTROPY_TOKENS)))
    reason = (
        F.when((F.col("chars_per_a") < b("least_a")) | (F.col("chars_per_b") < b("least_b")), "few characters per token")
        .when((F.col("chars_per_a") > b("most_a")) | (F.col("chars_per_b") > b("most_b")), "many characters per token")
        .when(F.col("fallback_share") > b("most_fallback"), "bytes")
        .when(F.col("entropy") < reachable, "entropy")
    )
    judged = known.withColumn("reason", F.when(F.col("base_failed"), "base").otherwise(reason))
    return judged.withColumn("kept", F.col("reason").isNull()).drop("__band")


def judge_documents(docs: DataFrame, path_a: str, path_b: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """`judge` of `measure`."""
    return judge(measure(docs, path_a, path_b), bands)
