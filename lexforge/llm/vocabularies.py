"""Public vocabularies, opened without special handling, and chunks of text encoded many at a time."""

from __future__ import annotations

from itertools import chain

import numpy as np

from .token_counts import byte_alphabet

#: Characters of chunks that are encoded as one text.
_JOINED = 1 << 12


class ByteVocabulary:
    """A byte-level vocabulary of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        spelt = lambda name: bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.bytes = [spelt(names.get(i, "")) for i in range(max(names, default=-1) + 1)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the fast form leaves out where tokens stand, which nothing here asks for
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each beginning with a space, end to end; and how many each has. Where a word follows the space and
        another character than white space ends the chunk, encoding begins anew behind it, so such chunks are laid end to end
        and their ids told apart by the bytes they stand for."""
        plain = np.array([len(c) > 1 and not c[1].isspace() and not c[-1].isspace() for c in chunks], bool)
        joined, counts = np.flatnonzero(plain).tolist(), np.zeros(len(chunks), np.int64)
        if len(joined) < 2:
            return self._encoded(chunks)
        texts, part, size = [], [], 0
        for k in joined:
            part.append(chunks[k])
            size += len(chunks[k])
            if size > _JOINED:
                texts.append("".join(part))
                part, size = [], 0
        texts.append("".join(part))
        ids, _ = self._encoded(texts)
        ends = np.cumsum(self.sizes[ids])
        stops = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in map(chunks.__getitem__, joined)])
        reached = np.searchsorted(ends, stops)
        if len(ends) != reached[-1] + 1 or not (ends[reached] == stops).all():
            return self._encoded(chunks)
        counts[joined] = np.diff(reached + 1, prepend=0)
        if len(joined) == len(chunks):
            return ids, counts
        rest = np.flatnonzero(~plain).tolist()
        others, n = self._encoded([chunks[k] for k in rest])
        counts[rest] = n
        all_ = np.empty(counts.sum(), np.int64)
        owner = np.repeat(plain, counts)
        all_[owner], all_[~owner] = ids, others
        return all_, counts


class PieceVocabulary:
    """A vocabulary of pieces of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.vocab_size())
        self.fallback = np.array([self.library.is_byte(i) for i in ids], bool)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.fallback[i] else p.replace("▁", " ").encode() for i in ids for p in [self.library.id_to_piece(i)]]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each has."""
        ids = self.library.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)
