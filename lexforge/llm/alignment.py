"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

A document is encoded by a byte-level vocabulary (A) and by a vocabulary of pieces (B). Byte offsets where a
token of each ends cut the document into groups, and every token of A in a group is linked with every token
of B in it. The corpus is kept inverted: for every pair of tokens, and every block of documents, one
compressed bitmap of the documents that hold the pair linked, and further ones, its planes, of the documents
in which the number of links less one has bit 0, 1, 2, … set. Batches of a task are merged into the bitmaps of
one block. Bits are counted as bitmaps are made, so the number of documents and of links of every pair
corpus-wide are sums over blocks, which Spark adds up before it shuffles them. The counts then meet the bitmaps
again, and bitmap by bitmap they are added to the documents whose bits are set, block by block.

A bitmap is compressed as a sorted list of 16-bit places, or as plain bits where these are fewer bytes.

Both tokenizers begin anew at a single space before a word, so that texts are cut there, and a task remembers
what became of a chunk.

Null and empty texts, and texts whose tokens do not spell out a space and the text, have no tokens: counts are
0 and their groups an empty string. Special strings in texts are plain text. Repeated rows stay repeated, and
each is a document of its own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, MEMO_ENTRIES, map_batches
from .components import stored
from .vocabularies import ByteVocabulary, PieceVocabulary

#: A single space before a word: no token of either vocabulary goes across its start.
_CUT = re.compile(r" (?<!  )(?=[^\s\x1c-\x1f\x85])")
#: Characters of texts whose new chunks are encoded together.
LEARN_CHARS = 1_000_000
#: Documents that a block has at most, and links of different pairs at which it is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 20
#: Links of a group that are written out one by one; those of larger groups are counted by their distinct tokens.
_WRITTEN_OUT = 1 << 12


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places first, first + 1, … of each of many stretches, end to end."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Side(NamedTuple):
    """What a tokenizer makes of chunks, end to end: ids, how many a chunk has, the group of each, and how many a group has."""

    ids: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    in_group: np.ndarray


class Aligner:
    """Encodes texts by both tokenizers and remembers chunks: their counts, groups and linked pairs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        #: ids in words: of A before another of A and before B; of B before another of B, before a group, and at the end
        decimals = [[str(i) for i in range(len(v.bytes))] for v in (self.a, self.b)]
        self.said = [d + end for of, ends in zip(decimals, (",|", (",", ";", ""))) for end in ends for d in of]
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        #: of every chunk: tokens of A and B, groups, links; whether its tokens spell it out; its groups in words
        self.counts, self.spelt, self.groups = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.cuts, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def grouped(self, chunks: list[str]) -> tuple[np.ndarray, Side, Side, np.ndarray]:
        """Whether each chunk is spelt out by its tokens; what A and B make of them (nothing, if it is not); and where groups
        end, in bytes of those that are, end to end."""
        encoded = [self.a.encode(chunks), self.b.encode([c[1:] for c in chunks])]
        raw = [c.encode() for c in chunks]
        whole = b"".join(raw)
        spelt = np.ones(len(chunks), bool)
        if any(b"".join(map(v.bytes.__getitem__, ids.tolist())) != whole for v, (ids, _) in zip((self.a, self.b), encoded)):
            for v, (ids, counts) in zip((self.a, self.b), encoded):
                cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
                spelt &= [b"".join(map(v.bytes.__getitem__, ids[i:j].tolist())) == r for i, j, r in zip(cut, cut[1:], raw)]
            encoded = [(ids[np.repeat(spelt, counts)], counts * spelt) for ids, counts in encoded]
        ends = [np.cumsum(v.sizes[ids]) for v, (ids, _) in zip((self.a, self.b), encoded)]
        common = np.intersect1d(*ends, assume_unique=True)
        sides = []
        for (ids, counts), end in zip(encoded, ends):
            group = np.searchsorted(common, end)
            sides.append(Side(ids, counts, group, np.bincount(group, minlength=len(common))))
        return spelt, *sides, common

    def learn(self, chunks: list[str]) -> None:
        spelt, a, b, common = self.grouped(chunks)
        size_b = len(self.b.bytes)
        first_a, first_b = (np.cumsum(x.in_group) - x.in_group for x in (a, b))
        chunk_of = np.repeat(np.arange(len(chunks)), a.counts)[first_a]  # of a group
        products = a.in_group * b.in_group
        # every token of A in turn, beside all tokens of B in its group
        times = np.where(products[a.group] <= _WRITTEN_OUT, b.in_group[a.group], 0)
        pairs = [np.repeat(a.ids, times) * size_b + b.ids[_ragged(first_b[a.group], times)]]
        owners, links = [np.repeat(chunk_of[a.group], times)], [np.ones(len(pairs[0]), np.int64)]
        for g in np.flatnonzero(products > _WRITTEN_OUT).tolist():
            (x, times_x), (y, times_y) = (np.unique(s.ids[first[g] : first[g] + s.in_group[g]], return_counts=True) for s, first in ((a, first_a), (b, first_b)))
            pairs.append((x[:, None] * size_b + y).ravel())
            links.append((times_x[:, None] * times_y).ravel())
            owners.append(np.full(len(pairs[-1]), chunk_of[g]))
        pairs, owners, links = (np.concatenate(x) for x in (pairs, owners, links))
        width = len(self.a.bytes) * size_b
        keys, links = _summed(owners * width + pairs, links)
        owners, pairs = keys // width, keys % width
        n_groups = np.bincount(chunk_of, minlength=len(chunks))
        n_links = np.zeros(len(chunks), np.int64)
        np.add.at(n_links, chunk_of, products)
        self.groups += self._in_words(a, b, chunk_of, n_groups)
        self.counts = np.concatenate([self.counts, np.stack([a.counts, b.counts, n_groups, n_links], axis=1)])
        self.spelt = np.concatenate([self.spelt, spelt])
        self.places.update(zip(chunks, range(len(self.places), len(self.places) + len(chunks))))
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(np.bincount(owners, minlength=len(chunks)))])
        self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])

    def _in_words(self, a: Side, b: Side, chunk_of: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of every chunk: ids joined by commas, A and B by a bar, groups by semicolons."""
        n, m = len(self.a.bytes), len(self.b.bytes)
        last = lambda x: np.append(x[1:] != x[:-1], True)[: len(x)]
        ends_chunk = last(chunk_of)[b.group] & last(b.group)
        code_a = a.ids + n * last(a.group)
        code_b = 2 * n + b.ids + m * last(b.group) + m * ends_chunk
        order = np.argsort(np.concatenate([2 * a.group, 2 * b.group + 1]), kind="stable")
        said = list(map(self.said.__getitem__, np.concatenate([code_a, code_b])[order].tolist()))
        cut = np.concatenate([[0], np.cumsum(a.counts + b.counts)]).tolist()
        return ["".join(said[i:j]) for i, j in zip(cut, cut[1:])]

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        """A space and the text, cut before single spaces that words follow."""
        first, *rest = _CUT.split(" " + text)
        return [first, *(" " + c for c in rest)] if first else [" " + c for c in rest]

    def align(self, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]]:
        """Slice by slice of texts: tokens of A and B, groups, links and groups in words of every text; and the number of a
        text in its slice, pair and number of links for every pair of every text."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and len(cut) < BLOCK_DOCS and (not cut or size + len(texts[at]) <= LEARN_CHARS):
                size += len(texts[at])
                cut.append(self.chunks_of(texts[at]) if texts[at] else [])
                at += 1
            if len(self.places) > MEMO_ENTRIES or len(self.pairs) > 20 * MEMO_ENTRIES:
                self._forget()
            known = len(self.places)
            if new := set().union(*cut).difference(self.places):
                long = [c for c in new if len(c) > MEMO_CHARS]
                self.learn([*new.difference(long), *long])  # those that are not remembered come last
            rows, owners, chunks = [], [], []
            for k, parts in enumerate(cut):
                place = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
                if not len(place) or not self.spelt[place].all():
                    rows.append((0, 0, 0, 0, ""))
                    continue
                rows.append((*self.counts[place].sum(axis=0).tolist(), ";".join(map(self.groups.__getitem__, place.tolist()))))
                place, times = np.unique(place, return_counts=True)
                owners.append(np.full(len(place), k))
                chunks.append((place, times))
            if owners:
                owner, place, times = np.concatenate(owners), *(np.concatenate([c[i] for c in chunks]) for i in (0, 1))
                counts = self.cuts[place + 1] - self.cuts[place]
                held = _ragged(self.cuts[place], counts)
                keys, links = _summed(self.pairs[held] * BLOCK_DOCS + np.repeat(owner, counts), self.links[held] * np.repeat(times, counts))
                yield rows, keys % BLOCK_DOCS, keys // BLOCK_DOCS, links
            else:
                yield rows, *(np.zeros(0, np.int64) for _ in range(3))
            self._drop_from(known + sum(len(c) <= MEMO_CHARS for c in new))

    def _drop_from(self, n: int) -> None:
        """Forget all chunks but the first n."""
        if n < len(self.places):
            self.places = {c: k for c, k in self.places.items() if k < n}
            self.counts, self.spelt, self.groups = self.counts[:n], self.spelt[:n], self.groups[:n]
            self.cuts = self.cuts[: n + 1]
            self.pairs, self.links = self.pairs[: self.cuts[-1]], self.links[: self.cuts[-1]]


@cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each two vocabularies in a worker, so that tasks that follow one another share what it remembers."""
    return Aligner(path_a, path_b)


def _bitmaps(keys: np.ndarray, places: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of sorted keys with sorted places below docs: the distinct keys, the number of their bits, and their compressed bitmaps."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    counts = np.diff(np.append(first, len(keys)))
    width = -(-docs // 8)
    dense = 2 * counts > width
    sizes = np.where(dense, width, 2 * counts)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(offsets[-1], np.uint8)
    short = np.repeat(~dense, counts)
    listed = places[short].astype("<u2").view(np.uint8)
    data[_ragged(offsets[:-1][~dense], sizes[~dense])] = listed
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(width * 8, np.uint8)
        bits[places[first[k] : first[k] + counts[k]]] = 1
        data[offsets[k] : offsets[k] + width] = np.packbits(bits)
    made = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return keys[first], counts, made.cast(pa.binary())


def places_of(bits: bytes, n: int) -> np.ndarray:
    """The n places whose bits a compressed bitmap has set."""
    if len(bits) == 2 * n:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: What one pass over the texts gives: documents, whose pair is null, and bitmaps. block and place: a document's. plane: -1 of the documents, or the bit of links less one.
_SCHEMA = f"{_DOCS}, block long, place int, pair long, plane int, n long, bits binary"


def _rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch in the order of _SCHEMA, of which only some columns are given."""
    kinds = {"groups_sha256": pa.string(), "place": pa.int32(), "plane": pa.int32(), "bits": pa.binary()}
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)


def _block_rows(keys: list[np.ndarray], links: list[np.ndarray], block: int, docs: int) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a block, of keys pair * BLOCK_DOCS + place: of its documents, and of the planes of their links less one."""
    key, more = np.concatenate(keys), np.concatenate(links) - 1
    order = np.argsort(key)
    key, more = key[order], more[order]
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        held = key if plane < 0 else key[(more >> plane & 1) > 0]
        pairs, counts, bits = _bitmaps(held // BLOCK_DOCS, held % BLOCK_DOCS, docs)
        numbers = {"block": np.full(len(pairs), block), "pair": pairs, "plane": np.full(len(pairs), plane), "n": counts}
        yield _rows({"bits": bits} | {c: pa.array(x, pa.int64()) for c, x in numbers.items()}, len(pairs))


def align_corpus(docs: DataFrame, path_a: str, path_b: str, bag: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One pass over docs(doc_id, text), whose result is written once. Documents: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256 (of `a1,a2|b1;a3|b2,b3`, the ids of each group), block and place. Bitmaps: block, pair (A's id times the
    size of vocabulary B, plus B's id), plane (-1: the documents that hold the pair linked; k: those whose number of links
    less one has bit k set), n (bits set) and bits. bag: takes the path of the table that both read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        part = TaskContext.get().partitionId() << 32
        block, n, keys, links = 0, 0, [], []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for rows, owner, pair, times in aligner.align(texts):
                if n + len(rows) > BLOCK_DOCS or sum(map(len, keys)) > BLOCK_POSTINGS:
                    yield from _block_rows(keys, links, part + block, n)
                    block, n, keys, links = block + 1, 0, [], []
                sha = [hashlib.sha256(said.encode()).hexdigest() if said else "" for *_, said in rows]
                numbers = {c: [r[k] for r in rows] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))} | {"block": [part + block] * len(rows), "place": range(n, n + len(rows))}
                yield _rows({"doc_id": batch.column(0).slice(at, len(rows)), "groups_sha256": pa.array(sha, pa.string())} | {c: pa.array(x, pa.int64()) for c, x in numbers.items()}, len(rows))
                keys.append(pair * BLOCK_DOCS + owner + n)
                links.append(times)
                n, at = n + len(rows), at + len(rows)
        if n:
            yield from _block_rows(keys, links, part + block, n)

    both = stored(_columns(docs).mapInArrow(run, _SCHEMA), bag)
    documents = both.where("pair IS NULL").select(*[c.split()[0] for c in _DOCS.split(", ")], "block", "place")
    return documents, both.where("pair IS NOT NULL").select("block", "pair", "plane", "n", "bits")


def pair_counts(bitmaps: DataFrame, size_b: int) -> DataFrame:
    """a_id, b_id, pair, n_docs (documents that hold the pair linked), n_links (their links) and is_best (no pair of this a_id
    has more documents)."""
    weight = F.pow(F.lit(2.0), F.greatest("plane", F.lit(0))).cast("long")
    counted = bitmaps.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links"))
    named = counted.select(F.floor(F.col("pair") / size_b).cast("int").alias("a_id"), (F.col("pair") % size_b).cast("int").alias("b_id"), "pair", "n_docs", "n_links")
    most = named.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # no more rows than vocabulary A has ids
    return named.join(most, "a_id").withColumn("is_best", F.col("n_docs") == F.col("most")).drop("most")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document of each block in turn, the sums over its links of the pairs' counts and of best pairs."""
    block, totals = None, np.zeros((2, BLOCK_DOCS), np.int64)

    def close() -> pa.RecordBatch:
        at = np.flatnonzero(totals[0])
        arrays = [pa.array(np.full(len(at), block, np.int64)), pa.array(at.astype(np.int32)), pa.array(totals[0, at]), pa.array(totals[1, at])]
        return pa.RecordBatch.from_arrays(arrays, ["block", "place", "count_sum", "n_best"])

    for batch in batches:
        blocks, planes, counts, n = (np.asarray(batch.column(c)) for c in ("block", "plane", "n_docs", "n"))
        best, bits = np.asarray(batch.column("is_best").cast(pa.int64())), batch.column("bits")
        weight = np.where(planes < 0, 1, np.int64(1) << np.maximum(planes, 0))
        listed = np.asarray(pc.binary_length(bits)) == 2 * n
        cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if blocks[a] != block:
                if block is not None:
                    yield close()
                block, totals = int(blocks[a]), np.zeros((2, BLOCK_DOCS), np.int64)
            own = np.flatnonzero(listed[a:b]) + a
            places = np.frombuffer(b"".join(bits.take(pa.array(own)).to_pylist()), "<u2").astype(np.int64)
            for k, share in ((0, weight * counts), (1, weight * best)):
                np.add.at(totals[k], places, np.repeat(share[own], n[own]))
            for row in (np.flatnonzero(~listed[a:b]) + a).tolist():
                places = places_of(bits[row].as_py(), int(n[row]))
                totals[0, places] += weight[row] * counts[row]
                totals[1, places] += weight[row] * best[row]
    if block is not None:
        yield close()


def score_documents(documents: DataFrame, bitmaps: DataFrame, counts: DataFrame) -> DataFrame:
    """documents with n_best (links whose pair is_best) and count_sum (the sum of n_docs over links), which every bitmap
    brings back to the documents whose bits it has set."""
    held = bitmaps.join(counts.select("pair", "n_docs", "is_best"), "pair").select("block", "plane", "n", "n_docs", "is_best", "bits")
    sums = held.repartition("block").sortWithinPartitions("block").mapInArrow(_sums, "block long, place int, count_sum long, n_best long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    kept = [c for c in documents.columns if c not in ("block", "place")]
    return documents.join(sums, ["block", "place"], "left").select(*kept, zero("n_best"), zero("count_sum"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every row of docs(doc_id, text)."""
    documents, bitmaps = align_corpus(docs, path_a, path_b)
    return score_documents(documents, bitmaps, pair_counts(bitmaps, size_of(path_b)))


def size_of(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and groups (array of start and stop, byte offsets in a space and the text, a_ids and b_ids) of every row of
    docs(doc_id, text)."""
    ids = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a_ids", ids), ("b_ids", ids)]))

    def make():
        aligner = aligner_of(path_a, path_b)

        def groups_of(text: str | None) -> list[dict]:
            if not text:
                return []
            spelt, a, b, ends = aligner.grouped(aligner.chunks_of(text))
            if not spelt.all():
                return []
            found = [{"start": int(a), "stop": int(b), "a_ids": [], "b_ids": []} for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            for name, side in (("a_ids", a), ("b_ids", b)):
                for token, g in zip(side.ids.tolist(), side.group.tolist()):
                    found[g][name].append(token)
            return found

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([groups_of(t) for t in batch.column(1).to_pylist()], kind)], ["doc_id", "groups"])

        return one

    return map_batches(_columns(docs), make, "doc_id long, groups array<struct<start: long, stop: long, a_ids: array<int>, b_ids: array<int>>>")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
