"""Token ids of a public vocabulary at the speed of a lookup.

The vocabulary of whole words lower-cases, drops white space and never joins what white space divides; inside a chunk it
always divides letters from other characters. A text's ids are therefore those of its pieces (runs of letters, runs of
other characters), one after the other, and each distinct piece is encoded once per worker. Chunks with an apostrophe
(endings such as 's are pieces of their own there), with ``<`` (special tokens) or with characters outside Latin-1
letters (composition, other classes) are one piece as they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._text import LOWER, byte_table

#: Bytes that a worker's cache takes before it starts anew; a piece counts with PIECE bytes besides its characters.
CACHE, PIECE = 48 << 20, 160
SPACE, LETTER, OTHER, WHOLE = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[byte_table((0x20, 0x20), (0x09, 0x0D))] = SPACE
CLASS[byte_table((0x41, 0x5A), (0x61, 0x7A))] = LETTER
CLASS[byte_table((0x80, 0xFF), (0x27, 0x27), (0x3C, 0x3C))] = WHOLE


def piece_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with plain letters in lower case, and where pieces (of text or white space) begin or end."""
    kind = CLASS[buf]
    second = np.zeros(len(buf), bool)
    second[1:] = buf[:-1] == 0xC3  # a Latin-1 letter's second byte; two of them are signs of multiplication and division
    latin = second & (buf != 0x97) & (buf != 0xB7)
    kind[latin] = LETTER
    kind[:-1][latin[1:]] = LETTER
    low = LOWER[buf]
    low[latin & (buf <= 0x9E)] += 0x20
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    white = np.ones(len(buf) + 1, bool)  # edges of chunks
    white[1:-1] = (kind[1:] == SPACE) != (kind[:-1] == SPACE)
    white[offs] = True
    at = np.flatnonzero(white)
    whole = np.add.reduceat(kind == WHOLE, at[:-1]) > 0 if len(buf) else np.zeros(0, bool)
    if whole.any():
        inside = np.repeat(whole, np.diff(at))
        low[inside] = buf[inside]
        edge[:-1][inside] = white[:-1][inside]
    return low, np.flatnonzero(edge)


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}  # piece -> its place in the two arrays
        self.starts, self.sizes, self.store = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32)
        self.ids = self.bytes = 0

    def ends_of_sentence(self) -> np.ndarray:
        """True for the ids that end a sentence."""
        vocab = self.model.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[vocab[t] for t in (".</w>", "!</w>", "?</w>") if t in vocab]] = True
        return out

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any("<" in p for p in pieces):
            got = [e.ids for e in self.model.encode_batch(pieces, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        got = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            ids, size = self._encode(some)
            n, m = len(self.slot), self.ids
            while n + len(some) > len(self.sizes):
                self.starts, self.sizes = np.concatenate([self.starts] * 2), np.concatenate([self.sizes] * 2)
            while m + len(ids) > len(self.store):
                self.store = np.concatenate([self.store] * 2)
            self.store[m : m + len(ids)] = ids
            self.sizes[n : n + len(some)] = size
            self.starts[n : n + len(some)] = m + np.cumsum(size) - size
            self.slot.update(zip(some, range(n, n + len(some)), strict=True))
            self.ids = m + len(ids)
            self.bytes += PIECE * len(some) + sum(map(len, some)) + 4 * len(ids)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the ids' offsets per text."""
        low, at = piece_bounds(buf, offs)
        cut = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low)).dictionary_encode()
        pieces = cut.dictionary.to_pylist()
        if self.bytes > CACHE:
            self._clear()
        fresh = [p for p in pieces if p not in self.slot]
        if fresh:
            self._learn(fresh)
        slot = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))[cut.indices.to_numpy()]
        size = self.sizes[slot]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.starts[slot] - (ends - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(at, offs)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
