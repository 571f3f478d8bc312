"""Isotonic calibration from binned scores: Spark counts, the driver pools at most a few thousand bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins a unit of score; scores are clipped to [-1, 2] first, so there are 3 * BINS + 1 bins at most.
BINS = 1000


def isotonic(scored: DataFrame, score: str = "raw", label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw, calibrated) of the best rising step function, by pooling adjacent violators over the bins.

    Without rows of both classes: the raw score, clipped to 0..1.
    """
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(score)))
    bins = scored.groupBy(F.round(clipped * BINS).cast("int").alias("bin"))
    bins = bins.agg(F.sum(F.col(label).cast("double")).alias("y"), F.count("*").alias("n"))
    rows = sorted((r["bin"], r["y"], r["n"]) for r in bins.collect())
    if not rows or sum(r[1] for r in rows) in (0, sum(r[2] for r in rows)):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    blocks: list[list[float]] = []  # first bin, last bin, labels, rows
    for b, y, n in rows:
        blocks.append([b, b, y, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, y1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0], last, blocks[-1][2] + y1, blocks[-1][3] + n1]
    x = np.array([v for b in blocks for v in b[:2]]) / BINS
    # half a row of either class keeps small blocks away from 0 and 1
    y = np.repeat([(b[2] + 0.5 * (b[2] > 0)) / (b[3] + 0.5 * (b[2] > 0) + 0.5 * (b[2] < b[3])) if 0 < b[2] < b[3] else (b[2] + 0.5) / (b[3] + 1) for b in blocks], 2)
    return x, np.maximum.accumulate(y)


def held_out(id_col: str, folds: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == remainder, F.lit(False))


def bounded(labelled: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """All labelled rows up to max_rows; beyond that a hash sample of about max_rows."""
    n = labelled.count()
    if n <= max_rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
