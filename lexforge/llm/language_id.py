"""Language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability, fitted by
expectation-maximisation over all segmentations of the words of a bounded sample of labelled texts. A
word's probability under a language is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words. Words repeat, so a worker remembers their scores.

Words are runs of letters and marks with a letter among them, the same in learning and in prediction,
of any length. The sample of a language are the SAMPLE_TEXTS distinct texts whose hashes are smallest, so
copies do not crowd out other texts. That is the only bound; statistics take in all words of the sample.

A text that is null or has no letter is "und" with score 0, as is every text if nothing is learned.
Texts are read whole. Repeated rows stay repeated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_CHARS, MEMO_ENTRIES, bound_batches, map_batches, remembered

#: Distinct labelled texts a language is learned from, and the most languages there may be.
SAMPLE_TEXTS, MOST_LANGUAGES = 3000, 2000
ROUNDS = 4
UNDETERMINED = "und"
_START = "▁"
_UNSEEN = 1e-8
#: Words up to this length are summed many at a time, in plain doubles; longer ones by themselves, in logarithms.
_LONG = 30
#: Words whose segmentations are laid out at once.
_TOGETHER = 4096
#: Texts of a column that are in memory as such at once.
_PART = 1000


@cache
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str], frozenset[str]]:
    """Runs of letters and marks, a letter, and the characters for which a run of word characters that are no digits and no
    underscore is something else than a run of letters: marks, and numbers that are no digits."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    inside = lambda of: "".join(f"{re.escape(chr(m.start()))}-{re.escape(chr(m.end() - 1))}" for m in re.finditer(of, kinds))
    odd = frozenset(chr(m.start()) for m in re.finditer("[MN]", kinds) if kinds[m.start()] == "M" or not chr(m.start()).isdecimal())
    return re.compile(f"[{inside('[LM]+')}]+"), re.compile(f"[{inside('L+')}]"), odd


_PLAIN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    run, letter, odd = _patterns()
    text = text.lower()
    if odd.isdisjoint(set(text)):
        return _PLAIN.findall(text)  # the same, and quicker
    return [w for w in run.findall(text) if letter.search(w)]  # marks without a letter are no word


@dataclass
class Lattice:
    """Every occurrence of a piece in a batch of words: which word, where it starts and ends, which piece."""

    pieces: dict[str, int]
    #: what some piece begins with: beyond, no longer piece need be looked for
    beginnings: set[str] = field(init=False)

    def __post_init__(self):
        self.beginnings = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    def edges(self, words: list[str]) -> np.ndarray:
        found, get, none, beginnings = [], self.pieces.get, len(self.pieces), self.beginnings
        for w, word in enumerate(words):
            marked, n = _START + word, len(word) + 1
            # the mark of a word's start is part of its first piece or a piece of its own
            for i in range(n):
                for j in range(i + 1, n + 1):
                    part = marked[i:j]
                    if (piece := get(part)) is not None:
                        found.append((w, i, j, piece))
                    elif j == i + 1:
                        found.append((w, i, j, none))
                    if part not in beginnings:
                        break
        return np.array(found, np.int64).reshape(-1, 4)


def forward(edges: np.ndarray, n: int, chances: np.ndarray) -> np.ndarray:
    """Probability of every prefix of n words: word x position x language. chances: piece x language."""
    size = int(edges[:, 2].max(initial=0)) + 1
    alpha = np.zeros((n, size, chances.shape[1]))
    alpha[:, 0] = 1
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    cuts = np.searchsorted(edges[:, 2], np.arange(1, size + 1))
    for end in range(1, size):
        word, start, _, piece = edges[cuts[end - 1] : cuts[end]].T
        np.add.at(alpha, (word, end), alpha[word, start] * chances[piece])
    return alpha


def backward(edges: np.ndarray, lengths: np.ndarray, chances: np.ndarray) -> np.ndarray:
    size = int(edges[:, 2].max(initial=0)) + 1
    beta = np.zeros((len(lengths), size, chances.shape[1]))
    beta[np.arange(len(lengths)), lengths] = 1
    edges = edges[np.argsort(edges[:, 1], kind="stable")]
    cuts = np.searchsorted(edges[:, 1], np.arange(size + 1))
    for start in range(size - 1, -1, -1):
        word, _, end, piece = edges[cuts[start] : cuts[start + 1]].T
        np.add.at(beta, (word, start), beta[word, end] * chances[piece])
    return beta


def long_sums(edges: np.ndarray, n: int, logs: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of every prefix of one word of n characters: position x language. logs: piece x language."""
    alpha = np.full((n + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    cuts = np.searchsorted(edges[:, 2], np.arange(1, n + 2))
    for end in range(1, n + 1):
        _, start, _, piece = edges[cuts[end - 1] : cuts[end]].T
        alpha[end] = np.logaddexp.reduce(alpha[start] + logs[piece], axis=0)
    return alpha


def long_expectations(edges: np.ndarray, n: int, logs: np.ndarray) -> np.ndarray:
    """How often each edge of one word of n characters is in a segmentation. logs: of the pieces, one language."""
    alpha = long_sums(edges, n, logs[:, None])[:, 0]
    turned = edges.copy()
    turned[:, 1], turned[:, 2] = n - edges[:, 2], n - edges[:, 1]
    beta = long_sums(turned, n, logs[:, None])[::-1, 0]
    _, start, end, piece = edges.T
    return np.exp(alpha[start] + logs[piece] + beta[end] - alpha[n])


def fixed_vocabulary(path: str) -> list[str]:
    """The lower-case pieces of letters of a public vocabulary, with and without the mark of a word's start."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (library.id_to_piece(i) for i in range(library.vocab_size()) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i))
    return sorted({p for p in pieces if (bare := p.removeprefix(_START)) == "" or (bare.isalpha() and bare == bare.lower())} | {_START})


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    #: piece x language; the last row is for single characters outside the vocabulary
    chances: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str]) -> Model:
    """counts: language -> word -> count."""
    languages = sorted(counts)
    pieces = {p: i for i, p in enumerate(vocabulary)}
    chances = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    lattice = Lattice(pieces)
    for at, language in enumerate(languages):
        words = sorted(counts[language])
        long = [w for w in words if len(w) > _LONG]
        short = [w for w in words if len(w) <= _LONG]
        laid_out = [(part, lattice.edges(part)) for part in (short[i : i + _TOGETHER] for i in range(0, len(short), _TOGETHER))]
        for _ in range(ROUNDS):
            own, expected = chances[:, at : at + 1], np.zeros(len(chances))
            for part, edges in laid_out:
                lengths = np.array([len(w) + 1 for w in part], np.int64)
                weight = np.array([counts[language][w] for w in part], float)
                alpha, beta = forward(edges, len(part), own), backward(edges, lengths, own)
                word, start, end, piece = edges.T
                share = alpha[word, start, 0] * own[piece, 0] * beta[word, end, 0] / alpha[word, lengths[word], 0]
                expected += np.bincount(piece, share * weight[word], minlength=len(chances))
            for word in long:
                edges = lattice.edges([word])
                expected += np.bincount(edges[:, 3], long_expectations(edges, len(word) + 1, np.log(own[:, 0])) * counts[language][word], minlength=len(chances))
            chances[:, at] = (expected + 1e-3) / (expected.sum() + 1e-3 * len(chances))
    chances[-1] = _UNSEEN
    return Model(languages, pieces, chances)


def train(labelled: DataFrame, path: str, texts: int = SAMPLE_TEXTS) -> Model:
    """A model of the languages of labelled(text, lang), from the `texts` distinct texts of each with the smallest hashes."""
    bound_batches(labelled.sparkSession)
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    order = Window.partitionBy("lang").orderBy("h")  # Spark keeps no more than `texts` rows a language and task of this
    smallest = hashed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= texts)
    limits = {r["lang"]: r["h"] for r in smallest.groupBy("lang").agg(F.max("h").alias("h")).limit(MOST_LANGUAGES + 1).collect()}
    if len(limits) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not limits:
        return Model([], {}, np.zeros((1, 0)))
    bound = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
    sample = known.where(F.xxhash64("text") <= bound[F.col("lang")]).distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((language, word) for word in words_of(text))
            rows = [pa.array([k[i] for k in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    totals = sample.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in totals.toLocalIterator():  # bounded: the words of `texts` texts a language
        counts.setdefault(row["lang"], {})[row["word"]] = row["n"]
    return fit(counts, fixed_vocabulary(path))


class Scorer:
    """Log-probabilities of words under each language, remembered within a task."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.places: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))
        self.logs = np.log(model.chances)

    def learn(self, words: list[str]) -> None:
        if len(self.places) > MEMO_ENTRIES:
            self.places.clear()
        short = [w for w in words if len(w) <= _LONG]
        long = [w for w in words if len(w) > _LONG]
        first = len(self.places)
        while len(self.table) < first + len(words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(short), _TOGETHER):
            part = short[at : at + _TOGETHER]
            alpha = forward(self.lattice.edges(part), len(part), self.model.chances)
            self.table[first + at : first + at + len(part)] = np.log(alpha[np.arange(len(part)), [len(w) + 1 for w in part]])
        for at, word in enumerate(long, first + len(short)):
            self.table[at] = long_sums(self.lattice.edges([word]), len(word) + 1, self.logs)[-1]
        self.places.update(zip(short + long, range(first, first + len(words))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for text in texts:
            words = words_of(text) if text else []
            if not words or not self.model.languages:
                languages.append(UNDETERMINED)
                scores.append(0.0)
                continue
            if unknown := sorted(set(words).difference(self.places)):
                self.learn(unknown)
                if not self.places.keys() >= set(words):  # the memory was emptied
                    self.learn(sorted(set(words).difference(self.places)))
            total = self.table[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(axis=0)
            if max(map(len, words)) > MEMO_CHARS:  # long words are not remembered; their rows are filled again when places run out
                kept = {w: i for w, i in self.places.items() if len(w) <= MEMO_CHARS}
                self.places = {w: i for i, w in enumerate(kept)}
                self.table[: len(kept)] = self.table[list(kept.values())]
            best = int(total.argmax())
            languages.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return languages, scores


    def predict_column(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """`predict` of a column, a part at a time."""
        parts = [self.predict(texts.slice(at, _PART).to_pylist()) for at in range(0, len(texts), _PART)]
        return [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]


def _scorer(model: Model) -> Scorer:
    """The scorer of a model; tasks that follow one another in a worker share what it remembers."""
    return remembered(model.name, lambda: Scorer(model))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of lang_pred under equal priors) of every row of docs(doc_id, text)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x languages

    def make():
        scorer = _scorer(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            languages, scores = scorer.predict_column(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return one

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(columns, make, "doc_id long, lang_pred string, score double", remembers=True)


def keep_determined(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is determined with a score above `least`: each row by its own
    text, without a shuffle."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        scorer = _scorer(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            languages, scores = scorer.predict_column(batch.column(at))
            return batch.filter(pa.array([language != UNDETERMINED and score > least for language, score in zip(languages, scores)], pa.bool_()))

        return one

    return map_batches(docs, make, docs.schema, remembers=True)
