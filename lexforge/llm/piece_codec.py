"""Offset-preserving SentencePiece (BPE) encoding and decoding.

A text is normalised by longest-prefix lookups in the model's compiled character map, which records
for each normalised byte the source byte it came from; a model whose map is empty changes nothing. The
normalised text is cut where a word begins, which no piece straddles, and adjacent symbols of a word are
merged, best-scored piece first and leftmost first among equals, a merge of each of many words at a time;
what is in no piece becomes bytes. The
pieces' lengths, laid end to end over the normalised bytes and projected through the recorded alignment,
give every piece's span of original bytes. The spans of a text tile it. Words repeat, so a task remembers
what became of them.

Nulls count as empty; empty texts have no tokens. Repeated rows stay repeated; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, MEMO_ENTRIES, map_batches

SPACE = "▁"
#: Characters of texts whose new words are merged together.
LEARN_CHARS = 1_000_000
#: The rank of a pair that makes no piece.
_NEVER = 1 << 30


class CharacterMap:
    """The compiled character map of a model: a double-array trie of source prefixes and the
    zero-terminated replacements that its values point to. An empty map changes nothing."""

    def __init__(self, compiled: bytes):
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.replacements = compiled[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of source[at:] in the map, and its replacement."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(source)):
            node ^= source[i]
            unit = units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[value : self.replacements.index(0, value)]
        return found

    def apply(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for the end, its source offset."""
        if not self.units:
            return source, np.arange(len(source) + 1)
        out, aligned, at = bytearray(), [], 0
        while at < len(source):
            hit = self.longest(source, at)
            if hit is None:
                first = source[at]
                hit = (n := 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4), source[at : at + n]
            out += hit[1]
            aligned += [at] * len(hit[1])
            at += hit[0]
        return bytes(out), np.array([*aligned, len(source)])


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, kinds = spec.normalizer_spec, spec.trainer_spec
        if not rules.escape_whitespaces or not rules.add_dummy_prefix or not kinds.byte_fallback or kinds.treat_whitespace_as_suffix or kinds.model_type != kinds.BPE:
            raise ValueError("only BPE models with byte fallback that escape white space before words are handled")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not handled")
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.squeeze = rules.remove_extra_whitespaces
        self.numbers = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == p.NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == p.NORMAL}
        self.pieces = [p.piece for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        # symbols: pieces, and characters of pieces that are no piece themselves and so end as bytes; others are numbered on as met
        self.symbols: dict[str, int] = {}
        self.symbol_decimals: list[str] = []
        self.symbol_plain: list[str] = []
        self.symbol_sizes = np.zeros((1 << 16, 2), np.int64)  # ids, and bytes
        for piece in [*self.numbers, *sorted({c for p in self.numbers for c in p})]:
            self.number_of(piece)
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = sorted((self.symbols[p[:k]] << 32 | self.symbols[p[k:]], order[score], self.symbols[p]) for p, score in self.scores.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.pairs = tuple(np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.array([-1]), np.array([_NEVER]), np.array([0]))
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == p.CONTROL}
        # words begin at the first of some space symbols, if no piece goes on beyond that
        straddled = any(SPACE in p.lstrip(SPACE) for p in self.numbers)
        self.words = re.compile(".+" if straddled else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)
        self._forget()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with spaces written as the space symbol, and source offsets of its bytes."""
        source = text.encode()
        changed, at = self.map.apply(source)
        if self.squeeze:
            kept, previous = [], True
            for i, b in enumerate(changed):
                if not (b == 32 and previous):
                    kept.append(i)
                previous = b == 32
            while kept and changed[kept[-1]] == 32:
                kept.pop()
            changed, at = bytes(changed[i] for i in kept), at[[*kept, len(changed)]]
        if not changed and (self.squeeze or not source):
            return "", at[-1:]
        raw = np.frombuffer(changed, np.uint8)
        widths = np.where(raw == 32, 3, 1)
        starts = np.concatenate([np.repeat(at[:1], 3), np.repeat(at[:-1], widths), at[-1:]])
        return (" " + changed.decode()).replace(" ", SPACE), starts

    def merged(self, word: str) -> list[str]:
        """The symbols that are left when no two neighbours make a piece."""
        symbols, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, heap = self.scores, []

        def offer(i: int, j: int) -> None:
            if (score := scores.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-score, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in symbols if x]

    def number_of(self, symbol: str) -> int:
        """The number of a symbol, which is a piece or a character."""
        if (number := self.symbols.get(symbol)) is not None:
            return number
        number = self.symbols[symbol] = len(self.symbols)
        ids = [self.numbers[symbol]] if symbol in self.numbers else [self.bytes[b] for b in symbol.encode()]
        self.symbol_decimals.append(",".join(map(str, ids)))
        self.symbol_plain.append(self.plain[ids[0]] if symbol in self.numbers else symbol)
        if number == len(self.symbol_sizes):
            self.symbol_sizes = np.concatenate([self.symbol_sizes, np.zeros_like(self.symbol_sizes)])
        self.symbol_sizes[number] = len(ids), len(symbol.encode())
        return number

    def _forget(self) -> None:
        """Begin anew what words were cut into: a word's place, and from where to where its symbols stand."""
        self.places: dict[str, int] = {}
        self.cuts = np.zeros(1, np.int64)
        self.held = np.zeros(0, np.int32)

    def _merged_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`merged` for many words: how many symbols are left of each, and the symbols. A round makes the best merge of every
        word that has one."""
        points, places = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), return_inverse=True)
        symbols = np.array([self.number_of(chr(c)) for c in points.tolist()], np.int64)[places]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        keys, ranks, results = self.pairs

        def looked_up(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and result of the pairs that begin at places `at`, which may be the last of a word."""
            following = np.minimum(at + 1, len(symbols) - 1)
            wanted = symbols[at] << 32 | symbols[following]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            held = (keys[found] == wanted) & (owner[at] == owner[following]) & (following > at)
            return np.where(held, ranks[found], _NEVER), np.where(held, results[found], 0)

        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = looked_up(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = best >> 32 < _NEVER
            at = best[live] & 0xFFFFFFFF
            if not live.all():
                kept = np.repeat(live, np.diff(np.append(starts, len(symbols))))
                done.append((owner[~kept], symbols[~kept]))
                at = at - np.cumsum(~kept)[at]
                symbols, owner, rank, made = symbols[kept], owner[kept], rank[kept], made[kept]
            if not len(at):
                break
            symbols[at] = made[at]
            rest = np.ones(len(symbols), bool)
            rest[at + 1] = False
            symbols, owner, rank, made = symbols[rest], owner[rest], rank[rest], made[rest]
            at = at - np.arange(len(at))
            for changed in (at, at[at > 0] - 1):
                rank[changed], made[changed] = looked_up(changed)
        owner, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return np.bincount(owner, minlength=len(words)), symbols[np.argsort(owner, kind="stable")]

    def _learn(self, words: list[str]) -> None:
        """Cut new words, and remember the symbols."""
        # words that are not short: a heap of neighbours each, as a round a merge would be quadratic
        short, long = ([w for w in words if (len(w) > MEMO_CHARS) == x] for x in (False, True))
        counts, symbols = self._merged_together(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cut = [[self.number_of(x) for x in self.merged(w)] for w in long]
        counts = np.concatenate([counts, np.array([len(x) for x in cut], np.int64)])
        self.held = np.concatenate([self.held, symbols.astype(np.int32), *(np.array(x, np.int32) for x in cut)])
        self.places.update(zip(short + long, range(len(self.cuts) - 1, len(self.cuts) - 1 + len(words))))
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(counts)])

    def split(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every text the symbols, and starts and ends of the byte spans of it that the ids of their pieces stand for."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= LEARN_CHARS):
                size += len(texts[stop])
                stop += 1
            normalised = [self.normalise(t) for t in texts[at:stop]]
            cut = [self.words.findall(changed) for changed, _ in normalised]
            if len(self.places) > MEMO_ENTRIES or len(self.held) > 20 * MEMO_ENTRIES:
                self._forget()
            if new := set().union(*cut).difference(self.places):
                self._learn(sorted(new))
            for (_, aligned), words in zip(normalised, cut):
                place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
                first, counts = self.cuts[place], self.cuts[place + 1] - self.cuts[place]
                symbols = self.held[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
                n_ids, widths = self.symbol_sizes[symbols].T
                if (n_ids > 1).any():  # bytes, one for each id
                    widths = np.repeat(np.where(n_ids > 1, 1, widths), n_ids)
                ends = np.cumsum(widths)
                yield symbols, aligned[ends - widths], aligned[ends]
            for word in [w for w in new if len(w) > MEMO_CHARS]:
                del self.places[word]
            at = stop

    def decimals_of(self, symbols: np.ndarray) -> str:
        """The ids of symbols, in decimal, joined by commas."""
        return ",".join(map(self.symbol_decimals.__getitem__, symbols.tolist()))

    def text_of(self, symbols: np.ndarray) -> str:
        """What the ids of symbols decode to."""
        return self.bare("".join(map(self.symbol_plain.__getitem__, symbols.tolist())))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Of every text ids, and starts and ends of the byte spans of the text that they stand for."""
        for symbols, starts, ends in self.split(texts):
            yield [int(i) for i in self.decimals_of(symbols).split(",")] if len(symbols) else [], starts, ends

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def joined(self, ids: list[int]) -> str:
        """The pieces end to end, with spaces; bytes that make no character become one replacement character each."""
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("\ufffd")
                at += n
            raw.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            flush()
            if i not in self.silent:
                out.append(self.plain[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.bare(self.joined(ids))

    def bare(self, text: str) -> str:
        """text without the space that encoding put before it."""
        return text.lstrip(" ") if self.squeeze else text.removeprefix(" ")


@cache
def codec_of(path: str) -> PieceCodec:
    """One for each model in a worker, so that tasks that follow one another share what it remembers."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Of every row of docs(doc_id, text): doc_id, ids (array of int), starts and ends (byte offsets of the pieces in the
    text) and decoded (text), as the sentencepiece library gives them without begin and end ids
    (the tests hold them to it)."""

    def make():
        codec = codec_of(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(codec.encode_all([text or "" for text in batch.column(1).to_pylist()]))
            lists = lambda k, kind: pa.array([x[k] for x in found], pa.list_(kind))
            arrays = [batch.column(0), lists(0, pa.int32()), lists(1, pa.int64()), lists(2, pa.int64()), pa.array([codec.decode(x[0]) for x in found], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "starts", "ends", "decoded"])

        return one

    return map_batches(_columns(docs), make, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """The outputs of `encode_documents`, brought down to digests in the same task, so that long arrays are never moved:
    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, decoded, and spans_sha256 (of the
    ends of the pieces' spans as little-endian 64-bit numbers)."""

    def make():
        codec = codec_of(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for symbols, _, ends in codec.split([text or "" for text in batch.column(1).to_pylist()]):
                decoded = codec.text_of(symbols)
                rows.append((len(ends), sha(codec.decimals_of(symbols).encode()), sha(decoded.encode()), sha(ends.astype("<i8").tobytes()), decoded))
            n, a, b, c, decoded = zip(*rows) if rows else ([],) * 5
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c, decoded))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "decoded"])

        return one

    return map_batches(_columns(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, decoded string")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
