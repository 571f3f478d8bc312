"""Packing: order-preserving dynamic programming over window cuts.

Each task lays its documents end to end and cuts the stream into windows of at most ``window`` tokens. Cuts are possible
at ends of documents (free) and sentences (``sentence_cost``), and where neither comes for ``stride`` tokens
(``word_cost``). Over these places

    f(j) = cost(j) + min( min over i in reach of f(i) + window - (pos j - pos i),
                          min over i a power of two back of f(i) + short_cost )

is the least sum of padding and truncation penalties. As the padding is linear in the positions, the first minimum is
one over a sliding window of f(i) + pos(i), kept in a monotone queue; each place enters and leaves it once.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import chunks, give_back, table, tuned
from ._tokens import default_vocabulary, tokenizer

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(pos: np.ndarray, cost: np.ndarray, window: int, short_cost: float = 4.0) -> list[int]:
    """Indices into pos of the best cuts, the first and last place included. pos rises by at most window a step."""
    n = len(pos)
    # places that lie a power of two before another, so that the window between them needs no padding
    sizes = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    back, front = [], []
    for s in sizes:
        i = np.searchsorted(pos, pos - s)
        hit = np.flatnonzero(pos[i] == pos - s)
        front.append(hit)
        back.append(i[hit])
    order = np.argsort(np.concatenate(front), kind="stable")
    back = np.concatenate(back)[order].tolist()
    upto = np.searchsorted(np.concatenate(front)[order], np.arange(n + 1)).tolist()
    p, c = pos.tolist(), cost.tolist()
    f, last = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(p[0]), 0)])
    for j in range(1, n):
        pj = p[j]
        while p[queue[0][1]] < pj - window:
            queue.popleft()
        g, at = queue[0]
        best = g + window - pj
        for k in range(upto[j], upto[j + 1]):
            if f[back[k]] + short_cost < best:
                at = back[k]
                best = f[at] + short_cost
        best += c[j]
        f[j], last[j] = best, at
        g = best + pj
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = last[j]
        cuts.append(j)
    return cuts[::-1]


def places(
    ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int, sentence_cost: float, word_cost: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and what a cut there costs."""
    cost = np.full(len(ids) + 1, np.inf, np.float32)
    cost[np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1] = sentence_cost
    cost[doc_ends] = 0
    cost[0] = 0
    pos = np.flatnonzero(np.isfinite(cost))
    gap = np.diff(np.append(pos, len(ids)))
    more = [np.arange(a + stride, a + g, stride) for a, g in zip(pos[gap > stride].tolist(), gap[gap > stride].tolist(), strict=True)]
    if more:
        more = np.concatenate(more)
        cost[more] = word_cost
        pos = np.flatnonzero(np.isfinite(cost))
    if pos[-1] != len(ids):
        pos, cost[len(ids)] = np.append(pos, len(ids)), word_cost
    return pos, cost[pos]


class Packer:
    """The stream of one task: documents come in, decided windows go out."""

    def __init__(self, window: int, block: int, ends: np.ndarray, stride: int, sentence_cost: float, word_cost: float):
        self.window, self.block, self.ends, self.costs = window, block, ends, (stride, sentence_cost, word_cost)
        self.ids = np.zeros(0, np.uint32)
        self.done = np.zeros(0, np.int64)  # of each open document: ids that earlier windows took
        self.size = np.zeros(0, np.int64)
        self.doc: list = []
        self.sequence = 0

    def add(self, doc: list, ids: np.ndarray, size: np.ndarray) -> dict | None:
        self.doc += doc
        self.ids = np.concatenate([self.ids, ids])
        self.size, self.done = np.concatenate([self.size, size]), np.concatenate([self.done, np.zeros(len(size), np.int64)])
        return self.flush(False) if len(self.ids) >= self.block else None

    def flush(self, final: bool) -> dict | None:
        if not len(self.ids):
            return None
        left = self.size - self.done
        doc_ends = np.cumsum(left)
        pos, cost = places(self.ids, doc_ends, self.ends, *self.costs)
        at = pos[cut(pos, cost, self.window)]
        if final:  # the last window is cut into powers of two, which need no padding
            a, rest = int(at[-2]), int(at[-1] - at[-2])
            if rest < self.window:
                bits = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
                at = np.concatenate([at[:-1], a + np.cumsum(bits)])
        elif len(at) > 2:
            at = at[:-1]
        else:
            return None
        out = self.pieces(at, doc_ends - left, left)
        taken = np.clip(at[-1] - (doc_ends - left), 0, left)
        self.done += taken
        first = int(np.searchsorted(doc_ends, at[-1], "right"))
        self.doc, self.done, self.size, self.ids = self.doc[first:], self.done[first:], self.size[first:], self.ids[at[-1] :]
        self.sequence += len(at) - 1
        return out

    def pieces(self, at: np.ndarray, doc_start: np.ndarray, left: np.ndarray) -> dict:
        ends = doc_start + left
        bounds = np.unique(np.concatenate([at, ends[ends < at[-1]]]))
        a, b = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, a, "right")
        seq = np.searchsorted(at, a, "right") - 1
        view = memoryview(np.ascontiguousarray(self.ids, "<u4")).cast("B")
        return {
            "doc": [self.doc[d] for d in doc],
            "start": self.done[doc] + a - doc_start[doc],
            "length": b - a,
            "ids_crc32": np.fromiter((zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a)),
            "doc_tokens": self.size[doc],
            "sequence_id": self.sequence + seq,
            "offset": a - at[seq],
        }


def pack(
    df: DataFrame, vocabulary: str | None = None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
    *, block: int = 1 << 18, stride: int = 128, sentence_cost: float = 2.0, word_cost: float = 16.0,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    There is no shuffle: each task packs the rows of its partition in their order, with memory bounded by ``block``
    tokens plus its longest document; sequence ids carry the partition, so they change where rows are dealt anew. A rerun of a task repeats its sequences if its
    rows come in the same order, as a scan's do. A sequence that is neither full nor a power of two long is padded to the
    window. Of cuts of equal cost the first found stays. A null or empty text is the end id alone; a null id passes
    through; repeated rows are packed each; an empty table gives no pieces; other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = rows.dtypes[0][1]

    def run(batches):
        tok = tokenizer(vocabulary)
        packer = Packer(window, block, tok.ends_of_sentence(), stride, sentence_cost, word_cost)
        high = TaskContext.get().partitionId() << 36

        def out(made, like):
            made["sequence_id"] = made["sequence_id"] + high
            return pa.RecordBatch.from_arrays([pa.array(made.pop("doc"), like), *map(pa.array, made.values())], names=[id_col, *made])

        like = None
        for batch in batches:
            like = batch.column(0).type
            for row, stop, buf, at in chunks(batch.column(1)):
                ids, offs = tok.encode(buf, at)
                ids = np.insert(ids, offs[1:], end_id)
                made = packer.add(batch.column(0).slice(row, stop - row).to_pylist(), ids, np.diff(offs) + 1)
                if made:
                    yield out(made, like)
        made = packer.flush(True)
        if made:
            yield out(made, like)
        give_back()

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(tuned(spark), sf_dir, "documents"))
