"""A counting sketch of keys: which keys surely stand alone.

Every key has two cells in one block of CELLS cells; a cell counts the rows that fall on it. A key with a cell that one row
alone fell on has that one row: no other row has the key. All else may repeat, and is left to exact grouping. As a
count-min estimate: the least of a key's two counts is never below its rows, so an estimate of one proves a singleton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import saved

#: Cells of a block; a bit each, packed into words of 64, is 8 KB.
CELLS = 1 << 16
#: Cells a row, as long as the blocks last: some 6 % of rows that stand alone then pass for possible repeats.
CELLS_PER_ROW = 8
#: Blocks of a sketch, which bounds its broadcast by 16 MB. Up to 16 million rows it has CELLS_PER_ROW cells a row; beyond,
#: it fills and clears fewer rows, which costs time and changes no result. A cluster with memory for it can allow more.
MAX_BLOCKS = 1 << 11


def _cells(b: Column) -> list[Column]:
    return [b.bitwiseAND(F.lit(CELLS - 1)), F.shiftrightunsigned(b, 20).bitwiseAND(F.lit(CELLS - 1))]


def sketch(keys: DataFrame, a: str, b: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(a table of the cells that two rows or more fell on, as bits by block; the number of blocks). a and b are two hashes
    of a key, long; keys is a saved table, since it is read twice. Counts combine before they are shuffled."""
    rows = keys.count()
    blocks = 1
    while blocks < max_blocks and blocks * CELLS < rows * CELLS_PER_ROW:
        blocks *= 2
    at = keys.select(F.pmod(F.col(a), F.lit(blocks)).alias("block"), F.explode(F.array(*_cells(F.col(b)))).alias("cell"))
    several = at.groupBy("block", "cell").agg(F.count("*").alias("n")).where("n > 1")

    def pack(cells: pa.Table) -> pa.Table:
        bits = np.zeros(CELLS, np.uint8)
        bits[cells["cell"].to_numpy()] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pa.table({"__block": cells["block"][:1], "__words": pa.array([words], pa.list_(pa.int64()))})

    return saved(several.groupBy("block").applyInArrow(pack, "__block long, __words array<bigint>"), "sketch"), blocks


def perhaps_repeated(rows: DataFrame, made: tuple[DataFrame, int], a: str, b: str, name: str) -> DataFrame:
    """The rows with a column that is false for keys that surely stand alone. The sketch is a bounded broadcast, so that
    no row is shuffled and no key is hot."""
    table, blocks = made
    met = rows.join(F.broadcast(table), F.pmod(F.col(a), F.lit(blocks)) == F.col("__block"), "left")
    bit = lambda c: F.getbit(F.element_at("__words", (F.shiftright(c, 6) + 1).cast("int")), c.bitwiseAND(F.lit(63)).cast("int")) == 1
    first, second = (bit(c) for c in _cells(F.col(b)))
    return met.withColumn(name, F.coalesce(first & second, F.lit(False))).drop("__block", "__words")
