"""Token-id packing by best-fit decreasing.

Documents become ids; documents longer than a row are split into row-long parts and a rest, losing
nothing. Parts are dealt to shards by a hash that takes in a number of the row, so that parts with equal
or no doc_id are dealt out too; which shard a part is in follows how the input is split. Within a shard,
longest first, each goes to the open row with the least room that still holds it, which a segment tree
over capacities finds in logarithmic time. A row of the result is a row of a packed matrix: the ids,
padded; the cumulative lengths of its segments; and where positions start again from zero.

Null and empty texts have no tokens and no part. A null doc_id sorts last and stays null. Repeated rows
are packed as often as they stand; each row of the input has a number, by which `unpack` gives every one
back, and which settles the order of equal parts. Empty tables give no rows. Only the columns named are read, whatever
others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
#: Bytes of text a shard is to hold: a task packs one shard at a time, in a few hundred rows.
SHARD_BYTES = 2_000_000
#: Texts whose parts a task gives out at once.
TEXTS = 200


class Capacities:
    """A segment tree over room left, 0 to length: which rooms have an open row."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The smallest room of at least `least` with an open row, and the row, which is taken out."""
        node = least + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):  # up, until there is something to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes into sizes (1 to length each), which must stand in decreasing order."""
    open_rows, rows = Capacities(length), []
    for i, size in enumerate(sizes):
        if (hit := open_rows.take(size)) is None:
            hit = length, len(rows)
            rows.append([])
        rows[hit[1]].append(i)
        if hit[0] > size:
            open_rows.put(hit[0] - size, hit[1])
    return rows


_PARTS = "doc_id long, source long, part int, n int, ids binary"
_PACKED = "shard int, row int, n_tokens int, n_segments int, doc_ids array<long>, sources array<long>, parts array<int>, cu_seqlens array<int>, resets array<int>, input_ids binary"
_PACKED_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def token_parts(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, source (the number of the row), part, n and ids (little-endian 32-bit numbers) of the parts of every row of
    docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                rows = []
                for doc_id, source, text in zip(*(batch.slice(first, TEXTS).column(k).to_pylist() for k in range(3))):
                    ids = np.array(library.encode(text), "<i4") if text else ()
                    rows += [(doc_id, source, at // length, len(ids[at : at + length]), ids[at : at + length].tobytes()) for at in range(0, len(ids), length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], ["doc_id", "source", "part", "n", "ids"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("source"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, _PARTS)


def pack(docs: DataFrame, path: str, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The packed rows of docs(doc_id, text): shard, row, n_tokens, n_segments, doc_ids, sources (numbers of the rows of docs),
    parts, cu_seqlens (from 0), resets (the offsets at which positions start again) and input_ids (length little-endian 32-bit
    numbers, padded with pad)."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def packed(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        doc_ids, sources, parts, sizes = (table[c].to_pylist() for c in ("doc_id", "source", "part", "n"))
        ids = table["ids"]
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], doc_ids[i] is None, doc_ids[i] or 0, sources[i], parts[i]))
        rows = []
        for row, members in enumerate(best_fit_decreasing([sizes[i] for i in order], length)):
            own = [order[i] for i in members]
            ends = np.cumsum([sizes[i] for i in own]).tolist()
            body = b"".join([ids[i].as_py() for i in own]) + np.full(length - ends[-1], pad, "<i4").tobytes()
            rows.append((shard, row, ends[-1], len(own), [doc_ids[i] for i in own], [sources[i] for i in own], [parts[i] for i in own], [0, *ends], [0, *ends[:-1]], body))
        names = [c.split()[0] for c in _PACKED.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), _PACKED_TYPES)], names=names)

    dealt = token_parts(docs, path, length).withColumn("shard", F.pmod(F.xxhash64("source", "part"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(packed, _PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of every row that was packed, as often as it stood: the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                rows = []
                for r in batch.slice(at, TEXTS).to_pylist():
                    ids = np.frombuffer(r["input_ids"], "<i4")
                    rows += [(d, s, p, ids[a:b].tolist()) for d, s, p, a, b in zip(r["doc_ids"], r["sources"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 4, kinds)], ["doc_id", "source", "part", "ids"])

    parts = packed.select("doc_ids", "sources", "parts", "cu_seqlens", "input_ids").mapInArrow(run, "doc_id long, source long, part int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return parts.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids")).select("doc_id", "ids")


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a folder a shard, so that a shard's matrix is its rows' input_ids end to end."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)
