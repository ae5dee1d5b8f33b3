"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may stand in a document with up to floor(n * error_rate) edits. Split into one
piece more than that, at least one piece of such an occurrence is untouched. All pieces are searched at
once, exactly; the neighbourhood of each hit is verified with Myers' bit-parallel distance.

Items and texts are compared lower-cased and with runs of white space as one space. Null and blank items
match nothing, null and empty texts hold nothing; items may repeat, and each is reported. Documents are
read whole. Items are taken in blocks of a bounded size, each broadcast for one pass over the documents.
Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.05
#: Characters of items that one pass holds; a larger benchmark takes more passes.
BLOCK_CHARS = 4_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of item of nearly equal length, with their offsets."""
    n, parts = len(item), min(errors, len(item) - 1) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def alphabet_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], n: int, text: str, start: int, stop: int) -> tuple[int, int]:
    """Fewest edits between a pattern of n characters and any substring of text[start:stop], and the first end with them.

    One addition and a few logical operations on n-bit numbers bring a whole column of the edit matrix forward."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n, start
    for at in range(start, stop):
        equal = masks.get(text[at], 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best[0]:
            best = score, at + 1
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(item_id, text, int(len(text) * error_rate)) for item_id, text in items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces_of(text, errors):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """item_id, edits and end of the best occurrence of each item found in a normalised text."""
        if not self.items or not text:
            return
        starts: dict[int, set[int]] = {}
        for last, (length, at) in self.automaton.iter(text):
            for k, offset in at:
                starts.setdefault(k, set()).add(last + 1 - length - offset)
        for k, guesses in starts.items():
            item_id, item, errors = self.items[k]
            n, best = len(item), None
            exact = next((s for s in sorted(guesses) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                yield item_id, 0, exact + n
                continue
            if errors == 0:
                continue
            masks = self.masks.setdefault(k, alphabet_masks(item))
            for start, stop in self._windows(sorted(guesses), n, errors, len(text)):
                found = best_end(masks, n, text, start, stop)
                if found[0] <= errors and (best is None or found < best):
                    best = found
            if best is not None:
                yield item_id, *best

    @staticmethod
    def _windows(guesses: list[int], n: int, errors: int, size: int) -> Iterator[tuple[int, int]]:
        """The neighbourhoods of guessed starts, joined where they overlap."""
        start = stop = None
        for guess in guesses:
            a, b = max(0, guess - errors), min(size, guess + n + errors)
            if stop is not None and a <= stop:
                stop = max(stop, b)
                continue
            if stop is not None:
                yield start, stop
            start, stop = a, b
        if stop is not None:
            yield start, stop


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items of the benchmark, normalised, in blocks of about BLOCK_CHARS."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], t) for r in part.collect() if (t := normalised(r["text"]))]


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, n_edits and end_at (in the normalised text) of every item of benchmark(item_id, text) that stands in
    a row of docs(doc_id, text) with at most its budget of edits."""
    columns = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext

    def passed(items: list[tuple[int, str]]) -> DataFrame:
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matcher.matches(normalised(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "n_edits", "end_at"])

        return columns.mapInArrow(run, "doc_id long, item_id long, n_edits long, end_at long")

    return reduce(DataFrame.unionAll, map(passed, _blocks(benchmark)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, with all their columns, in which no item stands: each row by its own text, without a shuffle."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")

    def passed(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([text is None or next(matcher.matches(normalised(text)), None) is None for text in batch.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return reduce(passed, _blocks(benchmark), docs)
