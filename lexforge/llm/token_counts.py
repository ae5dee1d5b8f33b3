"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

A vocabulary string that is one pre-token and whose merges end in a single token always counts as
one, wherever it stands. `whole_tokens` proves that once for every vocabulary string. Counting then
looks pre-tokens up in that table and runs the merges only for the rest. Text is first cut at single
spaces, which byte-level pre-tokens never straddle, so that the work for a chunk is done once a task.

Nulls and empty texts have no tokens and no bytes; repeated rows stay repeated; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, MEMO_ENTRIES, map_batches

#: A space before further white space, or at the end: there the cut at spaces would change pre-tokens.
_UNSAFE = re.compile(r" (?:\s|$|[\x1c-\x1f\x85])")


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, in byte-level characters, that encode alone as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    bytes_of = byte_alphabet()
    proven = set()
    for piece, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if piece in special:
            continue
        try:
            text = bytes(bytes_of[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1 and [t.id for t in tokenizer.model.tokenize(piece)] == [number]:
            proven.add(piece)
    return frozenset(proven)


class Counter:
    """Counts the tokens of one text after another, remembering chunks and merged pre-tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = tokenizer.model.tokenize
        self.whole = whole
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def tokens_of(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        if (n := self.pieces.get(piece)) is None:
            n = len(self.merge(piece))
            if len(piece) <= 4 * MEMO_CHARS:  # in bytes; longer ones are merged each time they stand
                self.pieces[piece] = n
        return n

    def learn(self, chunks: list[str]) -> None:
        """Cut chunks, each after its space, in one call and remember their counts."""
        ends, end = [], 0
        for chunk in chunks:
            end += 1 + len(chunk)
            ends.append(end)
        i = n = 0
        for piece, (_, stop) in self.cut(" " + " ".join(chunks)):
            n += self.tokens_of(piece)
            if stop == ends[i]:
                self.chunks[chunks[i]] = n
                i, n = i + 1, 0

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if _UNSAFE.search(text):
            return self.merged(text)
        first, *chunks = text.split(" ")
        for memo in (self.chunks, self.pieces):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        if unknown := set(chunks).difference(self.chunks):
            self.learn(list(unknown))
        n = self.merged(first) + sum(map(self.chunks.__getitem__, chunks))
        for chunk in [c for c in unknown if len(c) > MEMO_CHARS]:
            del self.chunks[chunk]
        return n

    def merged(self, text: str) -> int:
        return sum(self.tokens_of(piece) for piece, _ in self.cut(text))

    def count(self, text: str) -> int:
        """Special strings count as one token each, as the library's default has it."""
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.count, parts))
        return self.plain(text)


def count_tokens(docs: DataFrame, path: str, over: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > over) of every row of docs(doc_id, text)."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def make():
        counter = Counter(path, whole.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            counts = [counter.count(t) if t else 0 for t in texts.to_pylist()]
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return one

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(columns, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)
