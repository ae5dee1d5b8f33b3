"""Suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts earlier.

Windows of LENGTH bytes that are equal have the same minimizer, so runs of windows are dealt out by the
hash of their minimizer, and each shard needs only its own runs' bytes:

1. One scan finds grams that are frequent. The order by which minimizers are chosen puts these last, so
   that a window at the edge of a frequent passage is dealt out by something rare. Only the dealing
   depends on what this scan finds.
2. One scan counts minimizers; a window whose minimizer stands once has no equal.
3. One scan cuts the runs of the other windows. Runs equal to an earlier one of the same batch are known
   to be repeats; the rest is dealt to shards, as many as the text needs. Under a minimizer with very many
   different runs, windows are dealt out one by one, by their own hash.
4. A shard builds the suffix array of its distinct runs by induced sorting. Neighbours with LENGTH common
   bytes are equal windows; all but the earliest are repeats.
5. A document's repeats are united and cut out.

What is broadcast is bounded: a table of frequent grams, and bitmaps of at most 16 MB of the minimizers that
repeat and of those with very many runs. A bitmap that is full lets rows through that nothing matches, which
costs their shuffle and no more.

A null text is empty. Windows never cross documents; documents shorter than LENGTH have none. Earlier
means a smaller doc_id, or an earlier start in the same document; rows with the same doc_id count as one
document; rows without one take no part and lose nothing. Texts of any length are read whole, in blocks.
Empty tables give no rows. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minimizers
from .common import free_name
from .components import discard, stored
from .near_duplicates import Bloom
from .shingles import mixed
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
#: A gram is frequent if repeats of it within small batches add up to so many; so many are known at most.
FREQUENT, MOST_FREQUENT = 64, 1 << 16
#: Bytes of text in which repeats of grams are looked for at once, and of which a suffix array is built at once.
SCAN_BYTES, ARRAY_BYTES = 1_000_000, 2_000_000
#: Bytes of text for each of the partitions that runs are dealt to, at least one for each shuffle partition of the session.
SHARD_BYTES = 32_000_000
#: A minimizer with more different runs than this has its windows dealt out one by one.
MOST_RUNS = 50_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def _encoded(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc_id, text.as_buffer().to_pybytes() if text.is_valid else b""


def _frequent_grams(docs: DataFrame) -> np.ndarray:
    """The table of grams that stand often. They are known by the low 32 bits of their hashes, of which the table has the
    last ones; some that share them with others may count as frequent, which changes only the dealing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            grams = np.sort(np.concatenate(held or [np.zeros(0, np.uint32)]))
            again, counts = np.unique(grams[1:][grams[1:] == grams[:-1]], return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(again.astype(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "c"])

        for batch in batches:
            for _, text in _encoded(batch):
                for at in range(0, len(text) - minimizers.GRAM + 1, SCAN_BYTES):
                    held.append(minimizers.gram_hashes(np.frombuffer(text[at : at + SCAN_BYTES + minimizers.GRAM - 1], np.uint8)).astype(np.uint32))
                    size += len(held[-1])
                    if size > SCAN_BYTES:
                        yield counted()
                        size = 0
        yield counted()

    found = _texts(docs).mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    rows = found.orderBy(F.desc("c"), "gram").limit(MOST_FREQUENT).select("gram").toPandas()  # bounded
    return minimizers.frequency_table(rows["gram"].to_numpy(np.int64).view(np.uint64))


def _minimizer_counts(docs: DataFrame, frequent, length: int) -> DataFrame:
    """key and c of the minimizers of at least two runs; c: how many there are, different ones within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, nexts, windows = ([np.zeros(0, np.uint64)] for _ in range(3))
            for _, text in _encoded(batch):
                for hashes, firsts, counts in minimizers.runs(text, length, frequent.value):
                    found.append(hashes)
                    nexts += hashes[1:], counts[-1:].view(np.uint64)
                    windows.append(counts.view(np.uint64))
            hashes = np.concatenate(found)
            # a run's form, as far as its own and its neighbours' minimizers tell
            forms = mixed(hashes ^ mixed(np.concatenate(nexts)) ^ np.concatenate(windows), 7)
            order = np.argsort(hashes)
            hashes, forms = hashes[order], forms[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
            counts, seen = np.diff(first, append=len(hashes)), hashes[first]
            # only minimizers that stand twice can have several forms
            twice = np.repeat(counts > 1, counts)
            group = np.repeat(np.arange(len(first)), counts)[twice]
            order = np.lexsort((forms[twice], group))
            kept = forms[twice][order]
            new = np.append(True, (kept[1:] != kept[:-1]) | (group[1:] != group[:-1]))[: len(kept)]
            different = np.maximum(np.bincount(group[new], minlength=len(first)), 1)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int64)), pa.array(different)], ["key", "c", "runs"])

    return _texts(docs).mapInArrow(run, "key long, c long, runs long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("runs").alias("runs")).where("c > 1").select("key", "runs")


def _cut_runs(docs: DataFrame, frequent, repeated, crowded, length: int) -> DataFrame:
    """key, doc_id, start and bytes of runs whose minimizer may be repeated, or of their single windows where it is crowded;
    bytes are null, and the key is a mere number to deal it out by, for one equal to an earlier one of its batch (of which stop
    is the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[int, bytes], tuple[int, int]] = {}
            repeats: list[tuple[int, int, int]] = []

            def add(key: int, doc_id: int, at: int, own: bytes) -> None:
                earlier = known.setdefault((key, own), (doc_id, at))
                if earlier > (doc_id, at):
                    known[key, own] = doc_id, at
                    repeats.append((*earlier, earlier[1] + len(own)))
                elif earlier != (doc_id, at):
                    repeats.append((doc_id, at, at + len(own)))

            for doc_id, text in _encoded(batch):
                for hashes, firsts, counts in minimizers.runs(text, length, frequent.value):
                    kept = np.flatnonzero(repeated.value.test(hashes.view(np.int64)))
                    dense = crowded.value.test(hashes[kept].view(np.int64)).tolist() if crowded.value.bits else [False] * len(kept)
                    for key, at, n, many in zip(hashes[kept].tolist(), firsts[kept].tolist(), counts[kept].tolist(), dense):
                        if many:
                            for start in range(at, at + n):
                                window = text[start : start + length]
                                add(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little"), doc_id, start, window)
                        else:
                            add(key, doc_id, at, text[at : at + n + length - 1])
            n, m = len(known), len(repeats)
            keys = np.array([k for k, _ in known], np.uint64).view(np.int64)
            dealt = mixed(np.array([r[0] for r in repeats], np.int64).view(np.uint64) ^ mixed(np.array([r[1] for r in repeats], np.uint64), 3), 5).view(np.int64)
            ids, starts = [p[0] for p in known.values()], [p[1] for p in known.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys, dealt])), pa.array(ids + [r[0] for r in repeats], pa.int64()),
                    pa.array(starts + [r[1] for r in repeats], pa.int64()), pa.array([None] * n + [r[2] for r in repeats], pa.int64()), pa.array([b for _, b in known] + [None] * m, pa.binary()),
                ],
                ["key", "doc_id", "start", "stop", "bytes"],
            )

    return _texts(docs).mapInArrow(run, "key long, doc_id long, start long, stop long, bytes binary")


def repeats_in(texts: list[bytes], doc_ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and start of every window of `length` bytes in texts, which begin at `starts` of documents, that has an equal
    at a smaller (doc_id, start)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64) + 2
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined[(begins + sizes)[:-1]] = 1  # between texts
    s = np.append(joined, 0)
    sa = suffix_array(s)
    common = permuted_common_prefixes(s, sa)[sa]
    group = np.cumsum(common < length)
    several = np.bincount(group)[group] > 1
    at, group = sa[several], group[several]
    of = np.searchsorted(begins, at, side="right") - 1
    whole = at + length <= begins[of] + sizes[of]
    at, group, of = at[whole], group[whole], of[whole]
    doc, place = doc_ids[of], starts[of] + at - begins[of]
    order = np.lexsort((place, doc, group))
    doc, place, group = doc[order], place[order], group[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = (doc != doc[first]) | (place != place[first])
    return doc[later], place[later]


def _united(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, with those that overlap or touch made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    # ends grow along a document: lift each document above the ones before it
    lift = np.cumsum(fresh) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    begins = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(begins)
    return doc[at], start[at], (reach - lift)[np.append(at[1:], len(doc)) - 1]


def _shard_repeats(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id, start and stop of repeats among runs, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int]] = []
        texts: list[bytes] = []
        places: list[tuple[int, int]] = []
        key, own, size = None, {}, 0

        def flush() -> pa.RecordBatch:
            doc = np.array([d for d, _, _ in done], np.int64)
            start, stop = np.array([a for _, a, _ in done], np.int64), np.array([b for _, _, b in done], np.int64)
            if texts:
                d, a = repeats_in(texts, np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64), length)
                doc, start, stop = np.concatenate([doc, d]), np.concatenate([start, a]), np.concatenate([stop, a + length])
            done.clear(), texts.clear(), places.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _united(doc, start, stop)], ["doc_id", "start", "stop"])

        def close() -> None:
            if len(own) > 1:  # a single text has no equal windows within itself: their minimizers stand at different places
                texts.extend(own)
                places.extend(own.values())
            own.clear()

        for batch in batches:
            for next_key, doc_id, start, stop, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "stop", "bytes"))):
                if text is None:
                    done.append((doc_id, start, stop))
                    continue
                if next_key != key:
                    close()
                    key = next_key
                    if size > ARRAY_BYTES:
                        yield flush()
                        size = 0
                # rows come by document and start: the first is the earliest
                if own.setdefault(text, (doc_id, start)) != (doc_id, start):
                    done.append((doc_id, start, start + len(text)))
                else:
                    size += len(text) + 1
            if len(done) > 200_000:
                yield flush()
                size = 0
        close()
        yield flush()

    return runs.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(run, "doc_id long, start long, stop long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start and stop of byte intervals, which may overlap, that cover exactly the repeated bytes of docs(doc_id, text)."""
    spark, bag = docs.sparkSession, []
    context = spark.sparkContext
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    frequent = context.broadcast(_frequent_grams(docs))
    counted = stored(_minimizer_counts(docs, frequent, length), bag)
    repeated, crowded = context.broadcast(Bloom(counted, "key")), context.broadcast(Bloom(counted.where(F.col("runs") > MOST_RUNS), "key"))
    discard(spark, bag)
    return _shard_repeats(_cut_runs(docs, frequent, repeated, crowded, length), length, parts)


def _with_spans(docs: DataFrame, length: int, name: str) -> DataFrame:
    spans = repeated_spans(docs.select("doc_id", "text"), length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias(name))
    return docs.join(spans, "doc_id", "left")


def _kept(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of text, how many bytes go, and in how many maximal intervals."""
    if not spans:
        return text, 0, 0
    starts, stops = np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans])
    _, starts, stops = _united(np.zeros(len(spans), np.int64), starts, stops)
    parts, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]), int((stops - starts).sum()), len(starts)


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (doc_id, text), spans in zip(_encoded(batch), batch.column(2).to_pylist()):
                kept, removed, n = _kept(text, spans)
                rows.append((doc_id, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length, "spans")
    return held.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with its texts less their repeated bytes, and n_chars, where there is one, counted anew. A character that loses
    some of its bytes goes; a text that loses nothing is returned as it is. Other columns may have any name."""

    def kept(texts, spans):
        import pandas as pd

        return pd.Series([t if t is None or s is None else _kept(t.encode(), list(s))[0].decode("utf-8", "ignore") for t, s in zip(texts, spans)], dtype=object)

    cut = F.pandas_udf(kept, "string")
    spans = free_name("spans", docs.columns)
    held = _with_spans(docs, length, spans)
    named = {"text": cut("text", spans)} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    for name, column in named.items():
        held = held.withColumn(name, column)
    return held.select(*docs.columns)
