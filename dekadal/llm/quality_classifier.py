"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

The features cos(w x + b) approximate a Gaussian kernel over standardised document statistics. Each partition sums its
own normal equations, Spark adds them up, and the driver solves systems of fixed size. They are summed by fold, so the
weights without a fold's rows cost one more solution and no pass; calibration uses those out-of-fold scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._calibrate import bounded, held_out, isotonic
from ._stats import NAMES, as_lists, doc_stats, from_lists
from ._text import map_texts, saved, table, tuned

FOLDS = 5


class Fourier:
    """d inputs to n features and a constant; seeded, so that all tasks agree."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), n))
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return map_texts(docs, "features array<float>", lambda buf, offs: {"features": as_lists(doc_stats(buf, offs))}, [id_col], text)


def moments(labelled: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    cols = [F.col("features")[i].cast("double") for i in range(d)]
    row = labelled.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    got = np.array([x or 0.0 for x in row])
    return got[:d], np.where(got[d:] > 1e-9, got[d:], 1.0)


def normal_equations(labelled: DataFrame, phi: Fourier, d: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold the sums Z'Z and Z'y. A partition emits its sums once, (features + 1)^2 / 2 numbers a fold."""
    m = len(phi.b) + 1
    tri = np.triu_indices(m)

    def run(batches):
        a, v = np.zeros((FOLDS, m, m)), np.zeros((FOLDS, m))
        seen = set()
        for batch in batches:
            z, y, fold = phi(from_lists(batch.column(0), d)), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                a[k] += own.T @ own
                v[k] += own.T @ y[fold == k]
                seen.add(k)
        for k in seen:
            flat = np.concatenate([a[k][tri], v[k]])
            columns = [pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "place", "value"])

    parts = labelled.select("features", "label", "fold").coalesce(16).mapInArrow(run, "fold int, place int, value double")
    sums = parts.groupBy("fold", "place").agg(F.sum("value").alias("value")).toPandas()  # (features + 1)^2 / 2 rows a fold
    out = {}
    for k, own in sums.groupby("fold"):
        flat = own.sort_values("place")["value"].to_numpy()
        a = np.zeros((m, m))
        a[tri] = flat[: len(tri[0])]
        out[int(k)] = a + np.triu(a, 1).T, flat[len(tri[0]) :]
    return out


def solve(parts: dict, ridge: float, leave: int | None = None) -> np.ndarray:
    own = [p for k, p in parts.items() if k != leave] or list(parts.values())
    a, v = sum(p[0] for p in own), sum(p[1] for p in own)
    return np.linalg.solve(a + ridge * np.eye(len(a)), v)


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", *, id_col: str = "doc_id", text: str = "text",
    n_features: int = 128, width: float = 4.0, ridge: float = 0.5, max_labelled: int = 500_000,
) -> DataFrame:
    """(id, held_out, score, predicted) per document.

    Learns from labelled rows whose crc32 of the id leaves another remainder than 1 by 3, at most about max_labelled of
    them (a hash sample beyond). The only inputs are statistics of the text. Null and empty texts have statistics 0 and
    a score like others; rows with a null label are not learnt from; without labels all scores are 0.5. Rows of one text
    get one score, wherever they lie; repeated rows stay, null ids pass through, and an empty table gives none; ids that
    labels repeat are learnt from as often. A very long text is one row of statistics, made in memory of some 40 bytes a
    byte. Extra columns are not read.
    """
    d = len(NAMES)
    rows = saved(statistics(docs, id_col, text), "quality-statistics")
    learn = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & ~held_out("__id", 3, 1))
    labelled = rows.join(learn, F.col(id_col) == F.col("__id")).withColumn("fold", F.pmod(F.xxhash64("__id"), F.lit(FOLDS)).cast("int"))
    labelled = bounded(saved(labelled.drop("__id"), "quality-labelled"), id_col, max_labelled)
    phi = Fourier(*moments(labelled, d), n_features, width)
    parts = normal_equations(labelled, phi, d)
    if parts:
        weights = solve(parts, ridge)
        without = {k: solve(parts, ridge, k) for k in parts}
        table_of = np.stack([without.get(k, weights) for k in range(FOLDS)])

        def out_of_fold(batches):
            for batch in batches:
                z = phi(from_lists(batch.column(0), d))
                raw = (z * table_of[batch.column(2).to_numpy()]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], names=["raw", "label"])

        knots = isotonic(labelled.select("features", "label", "fold").mapInArrow(out_of_fold, "raw double, label double"))
    else:
        weights, knots = np.zeros(n_features + 1), (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def apply(batches):
        for batch in batches:
            raw = phi(from_lists(batch.column(1), d)) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(raw, *knots))], names=[id_col, "score"])

    kind = dict(rows.dtypes)[id_col]
    scored = rows.select(id_col, "features").mapInArrow(apply, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
