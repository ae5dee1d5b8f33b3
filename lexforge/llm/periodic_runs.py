"""Runs: maximal stretches of words that repeat with a period.

A document's words are numbered, and suffix trees of them and of their reversal give the longest common
extension of any two places to the right and to the left in constant time. In each of the two orders of
words (one turned round against the other), the longest Lyndon word that begins at a place ends at the
next smaller suffix. Every run holds such a word as its root, so extending each of them to both sides as
far as its period goes finds all runs, each with its smallest period.

A run of LEAST_WORDS words, or of two periods if that is more, repeats windows of _WINDOW words that
together cover it. So words outside repeated windows are in no run, and only the stretches between them go
into the trees, parted by symbols that stand once. That changes what the trees cost, not what they find.

Null and empty texts, and texts without words, have no runs and collapse to an empty text. Each row is
judged by its own text: repeated rows stay repeated. Other columns are ignored, whatever their names.
A text is one task's work, in memory linear in its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .suffix_tree import SuffixTree, next_smaller

#: Words a run has at least.
LEAST_WORDS = 12
#: A run of length l >= max(LEAST_WORDS, 2 * period) has l - period >= LEAST_WORDS / 2 words that stand again a period later.
_WINDOW = LEAST_WORDS // 2
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def _in_repeated_windows(ids: np.ndarray) -> np.ndarray:
    """Which words are in a window whose hash stands more than once; equal windows have equal hashes."""
    n = len(ids) - _WINDOW + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    hashes = sum(mixed[k : k + n] * _FACTORS[k] for k in range(_WINDOW))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    edges[at] += 1
    edges[at + _WINDOW] -= 1
    return np.cumsum(edges)[:-1] > 0


def runs_of(ids: np.ndarray) -> np.ndarray:
    """start, length and period of every run among words given by numbers, by start and then period."""
    inside = _in_repeated_windows(ids)
    if not inside.any():
        return np.zeros((0, 3), np.int64)
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    # words that stand in no repeated window become one symbol a gap, which stands nowhere else
    kept = inside.copy()
    kept[begins] = True
    names, symbols = np.unique(ids[inside], return_inverse=True)
    places = np.flatnonzero(inside)
    gaps = np.searchsorted(places, begins)  # where in the concatenation each stretch begins
    symbols = np.insert(symbols + 1, gaps, len(names) + 1 + np.arange(len(gaps)))
    places = np.insert(places, gaps, -1)
    n = len(symbols)
    forth, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(forth.suffix_ranks(descending)) for descending in (False, True)])
    follows = np.append(symbols, 0)
    goes_on = (follows[i] == follows[j]) | ((i > 0) & (follows[i - 1] == follows[j - 1]))
    i, j = i[goes_on], j[goes_on]
    forth.prepare()
    back.prepare()
    start, stop = i - back.common(n - i, n - j), j + forth.common(i, j)
    period = j - i
    whole = stop - start >= np.maximum(LEAST_WORDS, 2 * period)
    found = np.unique(np.stack([places[start[whole]], (stop - start)[whole], period[whole]], axis=1), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def in_later_periods(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:-1] > 0


def _read(text: bytes | None) -> tuple[np.ndarray, bytes]:
    """Runs of a text, and what is left of it when every run keeps its first period only."""
    words = text.split() if text else []  # bytes are split at the six blanks of ASCII
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(words) < LEAST_WORDS or len(numbers) == len(words):
        return np.zeros((0, 3), np.int64), b" ".join(words)
    runs = runs_of(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    if len(runs):
        words = [words[k] for k in np.flatnonzero(~in_later_periods(runs, len(words))).tolist()]
    return runs, b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length and period, in words, by start and then period) and collapsed (the words that no
    run contains after its first period, joined by single spaces) of every row of docs(doc_id, text)."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_read(text) for text in batch.column(1).to_pylist()]
            counts = np.array([0] + [len(runs) for runs, _ in found])
            all_ = np.concatenate([np.zeros((0, 3), np.int64), *(runs for runs, _ in found)])
            structs = pa.StructArray.from_arrays([pa.array(all_[:, k]) for k in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), structs)
            return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([c for _, c in found], pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

        return one

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(columns, make, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
