"""Exact n-gram Jaccard join by signature trees.

Documents are sets of word shingles. Two are linked when 100 * intersection >= percent * union, and the
result gives every document the smallest document reachable over links. No link between different sets
is lost, no group is capped:

1. One scan gives each set's size, digest and min-hash keys. Equal sets become one.
2. Sets that share a key are joined in chunks of bounded size by a signature tree and exact tests. This
   only brings most near copies together early, so that large groups of copies cost little below.
3. Sets are seen in spans, which are hash classes of the shingles, about 512 shingles each. If two sets
   are similar, so are their shares of at least one span, and then the two shares' prefixes (in an order
   that puts known frequent shingles last) have a shingle in common; in the smaller share it stands in
   the still shorter prefix that a partner of its own size or more needs. Under each such shingle a
   signature tree over the spans' bitmaps gives the pairs of sets that may be linked.
4. Each such pair is tested by its exact intersection, and only tested links form components: first the
   pair of two groups that looks nearest, then, where it fails, every other pair of the two groups.

Shingles are compared by 64-bit hashes; sets are equal or linked as far as those tell.

Null texts and texts without words have no shingles, and are their own component. Texts with fewer words
than a shingle are one shingle. Rows with the same doc_id are given the same component. Rows with a null
doc_id link like others and get the smallest id of their component; where no row of it has an id, that is
null. Sets without an id are numbered from the largest id on for this, which must leave room for them.
Empty tables give no rows. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, discard, stored
from .shingles import mixed, shingle_set
from .signature_tree import LEAF, SignatureTree, bitmaps, link, needed

#: Min-hash keys of a set, each of two minima; sets, and bytes of them, that one group of step 2 joins, about.
KEYS, CHUNK, CHUNK_BYTES = 3, 256, 16_000_000
_ORDERS = [np.uint64(mixed(np.array([100 + k], np.uint64))[0] | np.uint64(1)) for k in range(2 * KEYS)]
#: Rows whose shingle sets a task holds at once when it profiles them.
SLICE = 2000
#: The largest block of spans that is met at once in step 3; a span is a bitmap and a few numbers.
BLOCK = 1024
#: Shingles of a span, at most, and bits of its bitmap; where groups are tested beyond their nearest pair, it has FINE bits.
SPAN = BITS = 512
FINE = 4096
#: A shingle counts as frequent from so many sets on; so many are known at most, as only the order depends on it.
FREQUENT, MOST_FREQUENT = 64, 65_536
#: Largest Bloom bitmap that is broadcast, in bits (16 MB); beyond, it only lets more rows through.
MOST_BITS = 1 << 27


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc_id, shingle_set(text.as_py(), words)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype())))


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, n, digest, keys), and one for each shingle in several sets of a batch (h, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, sizes, digests, minima, sets = [], [], [], [], []
            for doc_id, s in _sets(batch, words):
                ids.append(doc_id)
                sizes.append(len(s))
                digests.append(_digest(s))
                # hashes are mixed already, so multiples by odd numbers order them each in another way
                minima.append([(s * f).min() for f in _ORDERS] if len(s) else [0] * len(_ORDERS))
                sets.append(s)
            pairs = np.array(minima, np.uint64).reshape(-1, KEYS, 2)
            combined = mixed(pairs[:, :, 0] ^ mixed(pairs[:, :, 1], 100)).view(np.int64)
            keys = [k if size else k[:0] for k, size in zip(combined, sizes)]
            seen, counts = np.unique(np.concatenate(list(dict(zip(digests, sets)).values()) or [np.zeros(0, np.uint64)]), return_counts=True)
            shared = counts >= 3
            n, m = len(ids), int(shared.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + [None] * m, pa.int64()), pa.array(sizes + [None] * m, pa.int32()), pa.array(digests + [None] * m, pa.binary()),
                    pa.concat_arrays([_lists(keys, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seen[shared].view(np.int64))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(counts[shared].astype(np.int64))]),
                ],
                ["doc_id", "n", "digest", "keys", "h", "c"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n int, digest binary, keys array<long>, h long, c long")


class Bloom:
    """A bitmap of the numbers in a column, modulo a size that follows their count up to MOST_BITS."""

    def __init__(self, df: DataFrame, column: str):
        count = df.count()
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * count).bit_length())) if count else 0
        self.held = np.zeros(max(self.bits // 8, 4096), np.uint8)
        if not count:
            return
        place = F.pmod(F.col(column), F.lit(self.bits)) + 1
        parts = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
        for row in parts.collect():  # 4 KB each, 16 MB in all at most, in one job
            self.held[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bitmap"], np.uint8)

    def test(self, numbers: np.ndarray) -> np.ndarray:
        """Which of numbers may be in the column."""
        if not self.bits:
            return np.zeros(len(numbers), bool)
        place = np.mod(numbers.astype(np.int64), self.bits)
        return (self.held[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The rows of wanted(doc_id, ...) with the shingle sets of those documents. Texts that the bitmap of wanted ids rules
    out are not read into sets."""
    shared = docs.sparkSession.sparkContext.broadcast(Bloom(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(pa.array(shared.value.test(np.asarray(batch.column(0)))))
            for at in range(0, chosen.num_rows, 500):
                found = list(_sets(chosen.slice(at, 500), words))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), _lists([s.view(np.int64) for _, s in found], pa.int64())], ["doc_id", "shingles"])

    found = _texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, shingles array<long>")
    return found.join(wanted, "doc_id")


def _exact_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links a, b that join the groups of rows(doc_id, grp, shingles) with equal keys, as a spanning forest of each."""

    def run(table: pa.Table) -> pa.Table:
        ids, groups = (np.asarray(table[c]) for c in ("doc_id", "grp"))
        sets = [np.asarray(s.values).view(np.uint64) for s in table["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = min(8192, max(BITS, 1 << (2 * int(np.median(sizes)) - 1).bit_length()))

        def holds(i: int, j: int) -> bool:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return bool(shared >= needed(sizes[i] + sizes[j], percent))

        found = link(sizes, bitmaps(sets, bits), groups, percent, holds) if len(ids) > 1 else []
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def _early_links(docs: DataFrame, sets: DataFrame, words: int, percent: int, bag: list[str]) -> DataFrame:
    """Step 2: links between sets that share a min-hash key, chunk by chunk."""
    keyed = sets.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(8 * F.col("shingles") / CHUNK_BYTES)).cast("long")
    chunk = F.pmod(F.xxhash64("doc_id", "band"), chunks)
    wanted = keyed.drop("n").join(sizes, ["band", "key"]).select("doc_id", F.struct("band", "key", chunk.alias("chunk")).alias("k"))
    wanted = stored(wanted.groupBy("doc_id").agg(F.collect_list("k").alias("ks")), bag)  # at most KEYS of them
    rows = _sets_of(docs, wanted, words).select("doc_id", F.col("doc_id").alias("grp"), "shingles", F.explode("ks").alias("k"))
    return _exact_links(rows.select("doc_id", "grp", "shingles", "k.band", "k.key", "k.chunk"), ["band", "key", "chunk"], percent)


def _spans(s: np.ndarray, frequent: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Number of classes, prefix keys, how many of them are the shorter prefix, and members of every span of a set.

    A set of n shingles falls into the least power of two of classes with at most SPAN shingles on average, and also into
    twice as many if a larger partner would."""
    n = len(s)
    classes = 1 << max(0, -(-n // SPAN) - 1).bit_length()
    larger = 100 * n // percent
    for count in [classes, 2 * classes] if larger > SPAN * classes else [classes]:
        place = (s % np.uint64(count)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(count + 1))
        for a, b in zip(cuts, cuts[1:]):
            members = s[order[a:b]]
            if not len(members):
                continue
            at = np.minimum(np.searchsorted(frequent, members), max(len(frequent) - 1, 0))
            known = frequent[at] == members if len(frequent) else np.zeros(len(members), bool)
            ranked = np.concatenate([members[~known], members[known]])
            size = len(members)
            prefix = ranked[: size - -(-percent * size // 100) + 1]
            yield count, mixed(prefix, count), size - int(needed(2 * size, percent)) + 1, members


_SPAN_SCHEMA = "doc_id long, n int, short int, bits binary, keys array<long>"


def _span_rows(docs: DataFrame, frequent: np.ndarray, words: int, percent: int, size: int = BITS, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, n, bits (bitmap of size bits), keys (of its prefix) and short (how many are its shorter one) of every span of
    every document, or of those that a bitmap of wanted(doc_id) lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(wanted, "doc_id") if wanted is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bloom.value is not None:
                batch = batch.filter(pa.array(bloom.value.test(np.asarray(batch.column(0)))))
            for at in range(0, batch.num_rows, 1000):
                ids, keys, short, members = [], [], [], []
                for doc_id, s in _sets(batch.slice(at, 1000), words):
                    for _, prefix, least, own in _spans(s, shared.value, percent):
                        ids.append(doc_id)
                        keys.append(prefix.view(np.int64))
                        short.append(least)
                        members.append(own)
                bits = [b.tobytes() for b in bitmaps(members, size)]
                arrays = [pa.array(ids, pa.int64()), pa.array([len(m) for m in members], pa.int32()), pa.array(short, pa.int32()), pa.array(bits, pa.binary()), _lists(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "short", "bits", "keys"])

    return _texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, _SPAN_SCHEMA)


def _bucket_pairs(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, short: np.ndarray, signatures: np.ndarray, groups: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of two rows of different groups that some bucket may link, and how far apart their bitmaps are, in percent of
    their sizes; rows stand by key. short: whether the key is in the row's shorter prefix. A bucket of at most LEAF rows is a
    tree of one leaf; such leaves are compared together, those of larger trees one after the other."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(cuts, len(keys)))

    def judged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.where(sizes[a] == sizes[b], short[a] | short[b], np.where(sizes[a] < sizes[b], short[a], short[b]))
        chosen = (groups[a] != groups[b]) & smaller
        a, b = a[chosen], b[chosen]
        total = (sizes[a] + sizes[b]).astype(np.int64)
        far = np.bitwise_count(signatures[a] ^ signatures[b]).sum(axis=1, dtype=np.int64)
        fits = ((total - far) // 2 >= needed(total, percent)) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]).astype(np.int64))
        return a[fits], b[fits], (100 * far[fits] // np.maximum(total[fits], 1)).astype(np.int32)

    for size in np.unique(counts[(counts > 1) & (counts <= LEAF)]).tolist():
        rows = cuts[counts == size][:, None] + np.arange(size)
        for i in range(size):
            for j in range(i + 1, size):
                yield judged(rows[:, i], rows[:, j])
    for start, size in zip(cuts[counts > LEAF].tolist(), counts[counts > LEAF].tolist()):
        part = slice(start, start + size)
        if short[part].any() and (groups[part] != groups[start]).any():
            for left, right in SignatureTree(sizes[part], signatures[part], percent).candidates():
                yield judged(left + start, right + start)


def _candidates(spans: DataFrame, percent: int, nearest: bool, bag: list[str]) -> DataFrame:
    """Step 3: pairs x, y of sets of the groups a < b of spans(doc_id, grp, n, short, bits, keys), that span bitmaps cannot rule
    out; nearest: only the nearest one of each two groups, and `others`, whether there may be more."""
    spark = spans.sparkSession
    leading = F.explode(F.transform("keys", lambda key, i: F.struct(key.alias("key"), (i < F.col("short")).alias("short"))))
    buckets = spans.select("grp", leading.alias("k")).groupBy("k.key").agg(F.count("*").alias("size"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.max("k.short").alias("led"))
    buckets = stored(buckets.where("low < high AND led").select("key", "size"), bag)
    shared = spark.sparkContext.broadcast(Bloom(buckets, "key"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            kept = np.flatnonzero(shared.value.test(keys))
            row = np.searchsorted(offsets, kept, side="right") - 1
            led = kept - offsets[row] < np.asarray(batch.column("short"))[row]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(led), *(batch.column(c).take(row) for c in ("doc_id", "grp", "n", "bits"))], ["key", "short", "doc_id", "grp", "n", "bits"])

    rows = spans.select("keys", "short", "doc_id", "grp", "n", "bits").mapInArrow(chosen, "key long, short boolean, doc_id long, grp long, n int, bits binary")
    # a bucket beyond BLOCK rows is met in pairs of blocks; such buckets are few, as each has over BLOCK rows
    large = stored(buckets.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")), bag)
    blocked = rows.join(F.broadcast(large) if large.count() <= 100_000 else large, "key", "left")
    own = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1)))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y"))))
    dealt = blocked.withColumn("own", own).withColumn("pair", pair).select("key", "pair.x", "pair.y", "short", "doc_id", "grp", "n", "bits")
    names = ["a", "b", "x", "y", "far"]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def identity(table: pa.Table) -> np.ndarray:
            return np.asarray(table["key"]) ^ mixed((np.asarray(table["x"]) * 0x10001 + np.asarray(table["y"])).astype(np.uint64)).view(np.int64)

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = identity(table)
            signatures = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(keys), -1)
            ids, groups = np.asarray(table["doc_id"]), np.asarray(table["grp"])
            held, count = [np.zeros((0, 5), np.int64)], 0

            def flush() -> pa.RecordBatch:
                found = np.unique(np.concatenate(held), axis=0)
                del held[1:]
                if nearest:  # of each two groups, here already
                    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 4], found[:, 1], found[:, 0]))]
                    first = np.ones(len(found), bool)
                    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
                    found = found[first]
                return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(5)], names)

            for a, b, far in _bucket_pairs(keys, ids, np.asarray(table["n"]), np.asarray(table["short"]), signatures, groups, percent):
                if len(a):
                    swap = groups[a] > groups[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    held.append(np.stack([groups[a], groups[b], ids[a], ids[b], far], axis=1))
                    count += len(a)
                if count > 200_000:
                    yield flush()
                    count = 0
            yield flush()

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            last = identity(table)
            whole = 0 if last[0] == last[-1] else int(np.flatnonzero(last != last[-1])[-1]) + 1
            if whole:
                yield from pairs(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield from pairs(rest)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(paired, "a long, b long, x long, y long, far long")
    if not nearest:
        return found.select("a", "b", "x", "y").distinct()
    return found.groupBy("a", "b").agg(F.min(F.struct("far", "x", "y")).alias("p")).select("a", "b", "p.x", "p.y")


def _tested(docs: DataFrame, pairs: DataFrame, words: int, percent: int, bag: list[str]) -> DataFrame:
    """Step 4: pairs(a, b, x, y) with linked, by the exact intersection of the sets x and y."""
    pairs = stored(pairs, bag)
    ends = stored(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), bag)
    sets = stored(_sets_of(docs, ends, words).distinct(), bag)  # several for an id that stands over several texts
    side = lambda end: sets.select(F.col("doc_id").alias(end), F.col("shingles").alias("of_" + end))
    shared = F.size(F.array_intersect("of_x", "of_y"))
    union = F.size("of_x") + F.size("of_y") - shared
    return pairs.join(side("x"), "x").join(side("y"), "y").select("a", "b", "x", "y", (100 * shared >= percent * union).alias("linked"))


def _late_links(docs: DataFrame, grouped: DataFrame, frequent: np.ndarray, words: int, percent: int, bag: list[str]) -> DataFrame:
    """Steps 3 and 4: links a, b between the groups of grouped(doc_id, grp)."""
    spans = stored(_span_rows(docs, frequent, words, percent).join(grouped, "doc_id"), bag)
    first = stored(_tested(docs, _candidates(spans, percent, True, bag), words, percent, bag), bag)
    linked = first.where("linked").select("a", "b")
    # where the nearest pair fails and there may be others, all pairs of the two groups that are still apart are tested
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    joined = connected_components(linked, bag)
    side = lambda end: joined.select(F.col("node").alias(end), F.col("component").alias("of_" + end))
    failed = first.where(~F.col("linked")).join(side("a"), "a", "left").join(side("b"), "b", "left")
    failed = failed.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    several = lambda end: sizes.select(F.col("grp").alias(end), F.lit(True).alias("several_" + end))
    open_ = failed.join(several("a"), "a", "left").join(several("b"), "b", "left").where("several_a OR several_b").select("a", "b")
    open_ = stored(open_, bag)
    if open_.isEmpty():
        return linked
    concerned = stored(grouped.join(open_.select(F.explode(F.array("a", "b")).alias("grp")).distinct(), "grp", "left_semi"), bag)
    finer = stored(_span_rows(docs, frequent, words, percent, FINE, concerned).join(concerned, "doc_id"), bag)
    again = stored(_candidates(finer, percent, False, bag).join(open_, ["a", "b"], "left_semi"), bag)
    return linked.unionAll(_tested(docs, again, words, percent, bag).where("linked").select("a", "b"))


def _nameless_texts(docs: DataFrame, words: int) -> DataFrame:
    """text and digest of the distinct texts of rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(shingle_set(text.as_py(), words)) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["text", "digest"])

    return _texts(docs).where(F.col("doc_id").isNull()).select("text").distinct().mapInArrow(run, "text string, digest binary")


def _numbered(sets: DataFrame, first: int) -> DataFrame:
    """sets with doc_id, counted on from first."""
    sets = stored(sets.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = sets.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a task
    starts = [first + int(x) for x in np.cumsum([0, *(r["n"] for r in sizes)])[:-1]]
    offsets = sets.sparkSession.createDataFrame([(r["part"], a) for r, a in zip(sizes, starts)], "part int, start long")
    return sets.join(F.broadcast(offsets), "part").withColumn("doc_id", F.col("start") + F.col("at")).drop("part", "at", "start")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    rows, named, first = _named_sets(docs, words, percent)
    joined = rows.join(named, "digest", "left")
    component = F.when(F.col("component") < first, F.col("component")) if first is not None else F.col("component")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(component, "doc_id").alias("component_id"))


def _named_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int | None]:
    """doc_id, n and digest of every row; digest and component of every set; and from where on components are no ids."""
    spark, bag = docs.sparkSession, []
    profiles = stored(_profiles(docs, words))
    rows = profiles.where(F.col("digest").isNotNull()).select("doc_id", "n", "digest", "keys")
    filled = rows.where("n > 0")
    sets = filled.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys")).alias("r")).select("digest", "r.doc_id", "r.n", "r.keys")
    sets, first = stored(sets, bag), None
    if not (nameless := filled.where("doc_id IS NULL")).isEmpty():
        first = (rows.agg(F.max("doc_id")).first()[0] or 0) + 1
        alone = nameless.groupBy("digest").agg(F.min(F.struct("n", "keys")).alias("r")).join(sets.select("digest"), "digest", "left_anti")
        alone = stored(_numbered(alone.select("digest", "r.n", "r.keys"), first), bag)
        texts = _nameless_texts(docs, words).join(alone.select("digest", "doc_id"), "digest").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = _texts(docs).where(F.col("doc_id").isNotNull()).unionByName(stored(texts, bag))
        sets = sets.unionByName(alone)
    early = stored(_early_links(docs, sets, words, percent, bag), bag)
    groups = connected_components(early, bag)
    grouped = stored(sets.select("doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("grp")), bag)
    common = profiles.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    held = common.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").collect()  # bounded; sets the order of prefixes only
    frequent = np.unique(np.array([r["h"] for r in held], np.int64).view(np.uint64))
    final = connected_components(early.unionAll(_late_links(docs, grouped, frequent, words, percent, bag)), bag)
    named = sets.select("digest", "doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    named = stored(named)
    discard(spark, bag)
    return rows.select("doc_id", "n", "digest"), named, first


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of their component. Rows without an id go
    where a row of their component has one; of a component without ids one row stays."""
    rows, named, first = _named_sets(docs.select("doc_id", "text"), words, percent)
    later = rows.join(named, "digest").where("doc_id <> component").select("doc_id").distinct()
    if first is None:
        return docs.join(later, "doc_id", "left_anti")
    kept = docs.where(F.col("doc_id").isNotNull()).join(later, "doc_id", "left_anti").select(*docs.columns)
    # texts without words are in no component and stay
    known = _nameless_texts(docs, words).join(named, "digest", "left").select(F.col("text").alias("__text"), "component")
    nameless = docs.where(F.col("doc_id").isNull())
    judged = nameless.join(known, F.col("text").cast("string").eqNullSafe(F.col("__text")), "left")
    alone = judged.where(F.col("component") >= first).groupBy("component").agg(F.min_by(F.struct(*(nameless[c] for c in docs.columns)), "__text").alias("r"))
    return kept.unionByName(judged.where("component IS NULL").select(*docs.columns)).unionByName(alone.select("r.*"))
