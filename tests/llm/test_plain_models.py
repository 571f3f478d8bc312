"""Solutions and calibrations of the classifiers against plain ones; long texts through stages."""

import random

import numpy as np
from brute import prose
from pyspark.sql import functions as F

import corpus_pipeline
from dekadal.llm import _calibrate, jaccard_join, quality_classifier


def test_ridge_equals_a_plain_solution(spark):
    """The sums of partitions and folds, solved, against least squares over all rows at once, with a row per ridge term."""
    rng = np.random.default_rng(3)
    x, y, fold = rng.normal(size=(300, 6)), rng.integers(0, 2, 300), rng.integers(0, quality_classifier.FOLDS, 300)
    rows = spark.createDataFrame([([float(v) for v in a], float(b), int(k)) for a, b, k in zip(x, y, fold, strict=True)], "features array<float>, label double, fold int").repartition(5)
    mean, scale = quality_classifier.moments(rows, 6)
    assert np.allclose(mean, x.mean(0), atol=1e-6) and np.allclose(scale, x.std(0), atol=1e-6)
    phi = quality_classifier.Fourier(mean, scale, 40, 2.0)
    parts = quality_classifier.normal_equations(rows, phi, 6)
    z = phi(x.astype(np.float32).astype(float))
    for leave in (None, 0, quality_classifier.FOLDS - 1):
        own = fold != leave
        plain = np.linalg.lstsq(np.vstack([z[own], np.sqrt(0.5) * np.eye(41)]), np.concatenate([y[own], np.zeros(41)]), rcond=None)[0]
        assert np.allclose(quality_classifier.solve(parts, 0.5, leave), plain, atol=1e-6)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    z = quality_classifier.Fourier(np.zeros(5), np.ones(5), 20_000, 1.5)(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 1.5**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def steps(raw, label):
    """Isotonic regression by its min-max formula over the bins: the value at i is the largest, over starts a up to i, of the
    least mean of labels from a to any end from i on."""
    bins = np.floor(np.clip(raw, -1, 2) * _calibrate.BINS + 0.5).astype(int)
    at = np.unique(bins)
    n, y = (np.array([w[bins == b].sum() for b in at]) for w in (np.ones(len(raw)), label))
    mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
    value = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    x, out = [], []
    for i in range(len(at)):
        if i == 0 or abs(value[i] - value[i - 1]) > 1e-12:
            j = max(k for k in range(i, len(at)) if abs(value[k] - value[i]) <= 1e-12)
            x += [at[i] / _calibrate.BINS, at[j] / _calibrate.BINS]
            out += 2 * [(y[i : j + 1].sum() + 0.5) / (n[i : j + 1].sum() + 1)]
    return np.array(x), np.maximum.accumulate(out)


def test_calibration_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    for size in (1, 7, 90):
        raw = np.round(rng.uniform(-1.2, 2.2, size), 2) + 0.0003
        label = (rng.uniform(size=size) < np.clip(raw, 0.1, 0.9)).astype(float)
        if size == 90:
            label[:2] = 0, 1
        got = _calibrate.isotonic(spark.createDataFrame([(float(a), float(b)) for a, b in zip(raw, label, strict=True)], "raw double, label double").repartition(3))
        if label.sum() in (0, size):
            assert [list(g) for g in got] == [[0, 1], [0, 1]]
        else:
            x, y = steps(raw, label)
            assert np.allclose(got[0], x) and np.allclose(got[1], y)


def test_long_texts_through_the_stages(spark, tmp_path):
    """Texts above a chunk: a near copy is found, a benchmark passage and an address at the very end too."""
    rng = random.Random(6)
    long, item = prose(rng, 60_000), prose(rng, 40)
    assert len(long) > 1 << 18
    rows = [(1, long), (2, long + " more"), (3, prose(rng, 60_000) + " " + item), (4, prose(rng, 60_000) + " write to who.else@some.example.org"), (5, prose(rng, 50)), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, stages["toxicity"](spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 6]
    assert jaccard_join.jaccard_components(docs).where("doc_id = 2").first().component_id == 1
    clean = stages["decontamination"](spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [1, 4, 5, 6]
    masked = {r.doc_id: r.text for r in stages["personal_data"](spark, clean, str(tmp_path)).collect()}
    assert masked[1] == long and masked[6] is None and "@" not in masked[4] and masked[4].startswith(rows[3][1][:300_000])
    packed = stages["packing"](spark, clean, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == 4 and all(r.n == r.t for r in packed)
