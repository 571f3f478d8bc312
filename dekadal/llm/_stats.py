"""Statistics of a document's whole text as dense features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import LEAD, NOT_SPACE, byte_table, hits, ngrams, per_doc, run_hashes, running, runs
from .quality_rules import LETTER, SYMBOLS, distinct, dup_lines, repeat_words

UPPER, DIGIT = byte_table((0x41, 0x5A)), byte_table((0x30, 0x39))
PUNCT = byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
SHOUT, STOP, COMMA, BAR, NEWLINE = (byte_table((ord(c), ord(c))) for c in "!.,|\n")
HIGH = byte_table((0x80, 0xFF))

NAMES = [
    "log_chars", "log_words", "mean_word", "std_word", "upper", "digit", "punct", "symbol", "shout", "high", "newline", "stop", "comma", "bar",
    "dup_lines", "repeat_words", "distinct_words", "distinct_pairs", "caps_words", "digit_words", "punct_ended", "letterless",
]


def doc_stats(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES per document, all finite; an empty text has zeros. A row depends on its own text alone: all sums
    are of whole numbers, and no window reaches into a neighbour."""
    starts, ends, wo = runs(buf, offs, NOT_SPACE)
    h = run_hashes(buf, starts, ends)
    lead, upper, digit, letter = (running(t[buf]) for t in (LEAD, UPPER, DIGIT, LETTER))
    size = (lead[ends] - lead[starts]).astype(np.int64)
    n, chars = np.diff(wo), np.diff(lead[offs])
    words, every = np.maximum(n, 1), np.maximum(chars, 1)
    mean = per_doc(size, wo) / words
    letters = letter[ends] - letter[starts]
    digits = digit[ends] - digit[starts]
    caps = (upper[ends] - upper[starts] == letters) & (letters > 1)
    lines, dup = dup_lines(buf, offs, starts)
    share = lambda t: hits(t[buf], offs) / words
    spread = per_doc(np.minimum(size, 200) ** 2, wo) / words - np.minimum(mean, 200) ** 2
    doc = np.repeat(np.arange(len(n)), n)
    pairs = ngrams(h, 2)[doc[1:] == doc[:-1]]
    pair_offs = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])
    cols = [
        np.log1p(chars), np.log1p(n), np.minimum(mean, 50), np.sqrt(np.maximum(0, spread)),
        np.diff(upper[offs]) / every, np.diff(digit[offs]) / every, hits(PUNCT[buf], offs) / every,
        share(SYMBOLS), share(SHOUT), hits(HIGH[buf], offs) / every, share(NEWLINE), share(STOP), share(COMMA), share(BAR),
        dup / np.maximum(lines, 1), repeat_words(h, wo) / words, distinct(h, wo) / words, distinct(pairs, pair_offs) / words,
        hits(caps, wo) / words, hits(digits > 0, wo) / words, hits(PUNCT[buf[ends - 1]], wo) / words, hits(letters == 0, wo) / words,
    ]
    return np.stack(cols, 1).astype(np.float32)


def as_lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))


def from_lists(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
