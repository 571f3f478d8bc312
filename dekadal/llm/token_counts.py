"""Token counts: separator scan over flat, unindexed token files.

A token file is nothing but little-endian ids, each document ended by a separator id. Files are read in blocks, each a byte
range and a row of its own, so that a file of any size spreads over tasks; each block searches its ids for the separator
at once and keeps the lengths between, before the first and after the last. A running sum over the blocks of a file then
stitches the documents that cross block boundaries.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import map_texts, saved, shared_dir, table, tuned
from ._tokens import default_vocabulary, tokenizer

#: The first id beyond the vocabulary of words, which therefore no text's ids hold, not even those of a text that spells
#: out a special token.
END = 49408
#: Bytes of token files that one task searches.
TASK_BYTES = 32 << 20
#: Blocks whose summaries are ordered together.
GROUP = 4096


def _lines(docs: DataFrame, keep: list[str], vocabulary: str | None, end_id: int, text: str, width: int) -> DataFrame:
    """(keep, value): the ids of a text as a string of raw bytes."""
    vocabulary = vocabulary or default_vocabulary()
    if not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"end id {end_id} does not fit {width} bytes")

    def each(buf: np.ndarray, offs: np.ndarray) -> dict:
        ids, at = tokenizer(vocabulary).encode(buf, offs)
        if len(ids) and int(ids.max()) >= 1 << 8 * width:
            raise ValueError(f"id {int(ids.max())} does not fit {width} bytes; write with a larger width")
        if (ids == end_id).any():
            raise ValueError(f"a text holds the end id {end_id}; take one beyond the vocabulary")
        data = pa.py_buffer(np.ascontiguousarray(ids, f"<u{width}"))
        return {"ids": pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((width * at).astype(np.int32)), data])}

    return map_texts(docs, "ids binary", each, keep, text).select(*keep, F.col("ids").cast("string").alias("value"))


def _write(lines: DataFrame, path: str, end_id: int, width: int, parts: list[str]) -> None:
    separator = int(end_id).to_bytes(width, "little").decode("latin-1")
    lines.write.options(lineSep=separator, encoding="ISO-8859-1", compression="none").partitionBy(*parts).text(path)


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END, text: str = "text", width: int = 2,
) -> None:
    """Write the ids of the texts as flat files of ids of ``width`` bytes (2 or 4), one file a partition, its documents in
    the partition's order. Null and empty texts are an end id alone; repeated rows are written each; a very long text is
    one document, tokenised in one task; an empty table makes files without ids; other columns are not read.

    An id that does not fit the width, and a text that holds the end id, are errors: neither could be read back.

    Spark's own text writer does the writing, so that files are committed as Spark commits any output, to any store: a
    document is a line, and the line separator is the end id. This rests on the writer passing on the bytes of a line as
    they are, which it does without a compression codec; the tests read the files back id by id.
    """
    _write(_lines(docs, [], vocabulary, end_id, text, width), path, end_id, width, [])


def with_rows(docs: DataFrame) -> DataFrame:
    """The rows of a Parquet table with where they lie there, which no reader's splits change: __file, a hash of the file's
    path, and __row, counted in the file."""
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def write_token_runs(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END, text: str = "text", width: int = 2,
) -> None:
    """write_token_files for rows with __file and __row, so that each id is known again by its document's row: a file holds
    a run, rows that follow each other in one file of the table, and lies in the folder of that file and of the run's
    first row, __file=<file>/__first=<row>. How the table is split into tasks decides where runs end, and nothing else."""

    def runs(batches):
        file, row, first = None, -2, 0
        for batch in batches:
            files, rows = batch["__file"].to_numpy(), batch["__row"].to_numpy()
            new = np.ones(len(rows), bool)
            new[1:] = (files[1:] != files[:-1]) | (rows[1:] != rows[:-1] + 1)
            if len(rows):
                new[0] = file != files[0] or rows[0] != row + 1
                begun = np.where(new, rows, first)
                at = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                begun = begun[at]
                file, row, first = files[-1], rows[-1], begun[-1]
                yield batch.append_column("__first", pa.array(begun))

    lines = _lines(docs, ["__file", "__row"], vocabulary, end_id, text, width)
    runs_of = lines.mapInArrow(runs, "__file long, __row long, value string, __first long")
    ordered = runs_of.sortWithinPartitions("__file", "__first", "__row")  # as the writer wants it, so that it sorts no more
    _write(ordered.select("value", "__file", "__first"), path, end_id, width, ["__file", "__first"])


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, by the path that Spark lists."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    store, name = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest))
    return store.open_input_file(name)


def token_counts(spark: SparkSession, path: str, end_id: int = END, block_ids: int = 1 << 17, width: int = 2) -> DataFrame:
    """(file, document, start, n_tokens) of the documents of the token files below path: file is the path below path,
    document counts from 0 in its file, start is the place of its first id, n_tokens leaves out the separator. Ids after the
    last separator of a file are a document of their own; an empty file has none, and so has an empty folder's table; a
    document may be longer than a block, or than many. A file whose bytes are no whole number of ids is an error.

    A block of block_ids ids is a row and is searched independently; TASK_BYTES of blocks make a task. Only one summary
    row a block, without the documents inside it, is ordered: within a group of GROUP blocks, and then a row a group
    within a file, so that neither a large file nor its summaries are one task's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")  # contents are not read
    size = files.agg(F.sum("length")).first()[0] or 0
    step = width * block_ids
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    blocks = ranges.selectExpr("path", "block", f"least({step}, length - block * {step}) as n_bytes", f"block = (length - 1) div {step} as last")
    blocks = blocks.repartition(max(1, -(-size // TASK_BYTES)))
    base = f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"
    numbers = ("block", "size", "ends", "head", "tail")
    spark_schema = ", ".join(["file string", *[f"{c} long" for c in numbers], "last boolean", "inner array<bigint>", "starts array<bigint>"])

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def search(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                piece = batch.slice(at, 64)
                made: list[list] = [[] for _ in range(6)]
                for name, block, n_bytes in zip(*(c.to_pylist() for c in piece.columns[:3]), strict=True):
                    with opened(name) as file:
                        v = np.frombuffer(file.read_at(n_bytes, block * step), f"<u{width}")
                    found = np.flatnonzero(v == end_id)
                    ends = (found[0], len(v) - 1 - found[-1]) if len(found) else (len(v), len(v))
                    for column, x in zip(made, (len(v), len(found), *ends, np.diff(found) - 1, found[:-1] + 1), strict=True):
                        column.append(x)
                names = [name.rsplit(base, 1)[-1] if base in name else name.rsplit("/", 1)[-1] for name in piece["path"].to_pylist()]
                whole = [pa.array(np.array(c, np.int64)) for c in made[:4]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), piece["block"], *whole, piece["last"], lists(made[4]), lists(made[5])], ["file", *numbers, "last", "inner", "starts"])

    found = saved(blocks.mapInArrow(search, spark_schema), "token-blocks")
    # sums over the blocks before, within a group and then over the groups before; a document is open since the last separator
    own = found.drop("inner", "starts").withColumn("group", F.floor(F.col("block") / GROUP))
    within = Window.partitionBy("file", "group").orderBy("block")
    before, zero = within.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    near = own.withColumns({"seen": F.coalesce(F.sum("size").over(before), zero), "documents": F.coalesce(F.sum("ends").over(before), zero)})
    near = near.withColumn("closed", F.when(F.col("ends") > 0, F.col("seen") + F.col("size") - F.col("tail")))
    near = near.withColumns({"since": F.max("closed").over(before), "upto": F.max("closed").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    groups = near.groupBy("file", "group").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max("closed").alias("closed"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"__seen": F.coalesce(F.sum("size").over(earlier), zero), "__documents": F.coalesce(F.sum("ends").over(earlier), zero)})
    groups = groups.withColumn("__closed", F.coalesce(F.max(F.col("__seen") + F.col("closed")).over(earlier), zero)).drop("size", "ends", "closed")
    far = near.join(groups, ["file", "group"])
    since = lambda c: F.coalesce(F.col("__seen") + F.col(c), F.col("__closed"))
    scanned = far.select("file", "block", "size", "ends", "head", "last", (F.col("__seen") + F.col("seen")).alias("seen"), (F.col("__documents") + F.col("documents")).alias("documents"), since("since").alias("since"), since("upto").alias("upto"))
    scanned = scanned.withColumn("open", F.col("seen") + F.col("size") - F.col("upto"))
    one = "struct({} as k, {} as start, {} as n_tokens)"
    first = F.when(F.col("ends") > 0, F.array(F.expr(one.format("documents", "since", "seen + head - since"))))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array(F.expr(one.format("documents + ends", "seen + size - open", "open"))))
    stitched = scanned.select("file", "block", "documents", "seen", first.alias("first"), rest.alias("rest"))
    number, start = (lambda k: F.col("documents") + k + 1), (lambda x: F.col("seen") + x["starts"])
    inner = F.transform(F.arrays_zip("starts", "inner"), lambda x, k: F.struct(number(k).alias("k"), start(x).alias("start"), x["inner"].alias("n_tokens")))
    rows = found.select("file", "block", "inner", "starts").join(stitched, ["file", "block"])
    none = F.slice(inner, 1, 0)
    rows = rows.select("file", F.inline(F.concat(F.coalesce("first", none), inner, F.coalesce("rest", none))))
    return rows.select("file", F.col("k").alias("document"), "start", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, shard, document, start, n_tokens): the documents as token files, and their counts from these. A file's shard is
    the row of the table at which it begins; its documents are the rows from there on, so a document's id is found by its
    place in the table, however the table is split when it is read."""
    docs = with_rows(table(tuned(spark), sf_dir, "documents"))
    path = shared_dir(spark, "token-files")
    write_token_runs(docs, path)
    place = lambda name: F.regexp_extract("file", rf"__{name}=(-?[0-9]+)", 1).cast("long")
    counts = token_counts(spark, path).withColumns({"__file": place("file"), "shard": place("first")})
    counts = counts.withColumn("__row", F.col("shard") + F.col("document"))
    return docs.select("doc_id", "__file", "__row").join(counts, ["__file", "__row"]).select("doc_id", "shard", "document", "start", "n_tokens")
