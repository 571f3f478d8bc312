"""Vectorised work on UTF-8 texts inside Spark tasks, and small Spark helpers that the operators share.

A chunk of documents is one ``uint8`` buffer with document offsets, straight from Arrow. Words are found with a
byte table: every UTF-8 byte of a character outside ASCII is >= 0x80, so a class of characters that treats all of
them alike is a class of bytes.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is a chunk of its own, hashed in blocks of this size.
CHUNK = 1 << 18
#: Settings of a session whose tasks hand texts to Python: rows and bytes of an Arrow batch. A longer row is a batch alone.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def tuned(spark: SparkSession) -> SparkSession:
    """A session with Arrow batches of a few megabytes. The queries and stages, which are applications, call this for the
    session that they are given; the operators leave sessions as they are and work with any size of batch."""
    for key, value in BATCH.items():
        spark.conf.set(key, str(value))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder, which
    goes when the driver ends; a cluster has no such folder that all its machines share, so there this is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="dekadal-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder, read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text
ALNUM_LOWER = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: maps A-Z to a-z, all other bytes to themselves
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: bytes that begin a code point
LEAD = ~byte_table((0x80, 0xBF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_MULT = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_INV = np.uint64(pow(_MULT, -1, 1 << 64))
_POWER = np.full(CHUNK, np.uint64(_MULT))
_POWER[0] = 1
_POWER = np.cumprod(_POWER, dtype=np.uint64)
_INVERSE = np.full(CHUNK, _INV)
_INVERSE[0] = 1
_INVERSE = np.cumprod(_INVERSE, dtype=np.uint64)


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run ``buf[start:end]``, from one running sum over the buffer. Starts rise, and so do
    ends. The sum is taken in blocks, so that a long text needs memory for its runs only."""
    below, scale = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    upto = np.zeros(len(ends), np.uint64)
    carry, power, inverse = np.uint64(0), 1, 1  # at the block's first byte
    for at in range(0, len(buf) + 1, CHUNK):
        block = buf[at : at + CHUNK]
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = carry
        np.cumsum(_BYTE[block] * (_POWER[: len(block)] * np.uint64(power)), dtype=np.uint64, out=sums[1:])
        sums[1:] += carry
        own = slice(*np.searchsorted(starts, [at, at + CHUNK]))
        below[own] = sums[starts[own] - at]
        scale[own] = _INVERSE[starts[own] - at] * np.uint64(inverse)
        own = slice(*np.searchsorted(ends, [at, at + CHUNK]))
        upto[own] = sums[ends[own] - at]
        carry = sums[-1]
        power, inverse = power * pow(_MULT, CHUNK, 1 << 64) % (1 << 64), inverse * pow(int(_INV), CHUNK, 1 << 64) % (1 << 64)
    return mix((upto - below) * scale + (ends - starts).astype(np.uint64))


def hash_word(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(b, np.array([0]), np.array([len(b)]))[0])


def runs(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class within each document: starts, ends, and the run offsets per document."""
    mask = inside[buf]
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begin[first] = mask[first]
    end[last] = mask[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def running(mask: np.ndarray) -> np.ndarray:
    """How many places before each one, and before the end, the mask has. A text is below 2 GB, as Arrow's strings are."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=out[1:])
    return out


def hits(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many places of each document's slice the mask has."""
    return np.diff(running(mask)[offs]).astype(np.int64)


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values over each document's slice."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values; the last n-1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] * np.uint64(2 * k + 3))
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about CHUNK bytes; nulls are empty texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1)
        yield row, stop, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def give_back() -> None:
    """Return what a finished task has freed to the system: workers live on, and wait beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, schema: str, each: Callable, keep: list[str], text: str = "text") -> DataFrame:
    """Apply ``each(bytes, offsets) -> dict of columns`` to the texts, batch by batch; columns in keep pass through.

    Other columns of df are not read, whatever their names. Texts reach ``each`` in chunks of about CHUNK bytes, a longer
    text by itself and whole.
    """
    kept = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for row, stop, buf, offs in chunks(texts):
                made = each(buf, offs)
                cols = [batch.column(i).slice(row, stop - row) for i in range(len(keep))]
                cols += [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *made])
        give_back()

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in keep] + [schema]))


#: Bits of an id filter: its table of 64-bit words has at most FILTER_BITS / 64 rows, whatever the number of ids, which
#: bounds its broadcast by some 10 MB. More than tens of millions of ids let ever more other rows pass, which costs time and
#: changes no result.
FILTER_BITS = 1 << 24


def _place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, id_col: str) -> DataFrame:
    """(__word, __bits): a bit for each hash class of ids that the table of ids has."""
    at = ids.select(_place(id_col).alias("at"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("__bits")
    return saved(at.groupBy(F.floor(F.col("at") / 64).alias("__word")).agg(bits), "id-filter")


def passing(docs: DataFrame, id_col: str, words: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose id the filter lets pass (or, ``left_anti``, those whose id is surely not among its ids). The filter
    is a hash table in every task, so no text is shuffled."""
    words = F.broadcast(words)
    set_ = F.getbit(words["__bits"], (_place(id_col) % 64).cast("int")) == 1
    return docs.join(words, (F.floor(_place(id_col) / 64) == words["__word"]) & set_, how)


def having(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is in ids, a saved table; only rows that an id filter lets pass are shuffled."""
    return passing(docs, id_col, id_filter(ids, id_col)).join(ids.select(id_col).distinct(), id_col, "left_semi").select(docs.columns)


def lacking(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in ids, a saved table, null ids among them; only rows that an id filter lets pass
    are shuffled."""
    words = id_filter(ids, id_col)
    perhaps = passing(docs, id_col, words).join(ids.select(id_col).distinct(), id_col, "left_anti")
    return passing(docs, id_col, words, "left_anti").select(docs.columns).union(perhaps.select(docs.columns))
