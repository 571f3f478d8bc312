"""Models on tables: windows or patches in, predictions out. Models come from the caller; forests are Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_score(
    df: DataFrame, make_predict_fn: Callable, inputs: list[str], shape: list[int], n_outputs: int,
    batch_size: int = 32, name: str = "prediction",
) -> DataFrame:
    """Apply any model in batches: make_predict_fn() loads it once per worker and returns a function of numpy arrays.
    Inputs are flat arrays of doubles that are reshaped to ``shape``."""
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()) if n_outputs > 1 else T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[shape] * len(inputs))
    return df.withColumn(name, predict(*inputs))


def mc_dropout_score(
    df: DataFrame, make_predict_fn: Callable, keys: list[str], window: str, shape: list[int], ahead: int,
    n: int = 1000, batch_size: int = 32, seed: Column | None = None,
) -> DataFrame:
    """(keys, sample, horizon, value): a model with noise scored n times, each with its own seed as second input. The seed is
    a hash of the keys and sample, unless a column (of keys and sample) says otherwise."""
    seeds = df.repartition(*keys).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # a window moves once
    seeded = seeds.withColumn("__seed", (F.pmod(F.xxhash64(*keys, "sample"), F.lit(2**31)) if seed is None else seed).cast("double"))
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[shape, None])
    scored = seeded.withColumn("__p", predict(F.col(window), F.col("__seed")))
    return scored.select(*keys, "sample", F.posexplode("__p").alias("horizon", "value")).where(F.col("horizon") < ahead)


def grow_forest(
    windows: DataFrame, k: int = 8, trees: int = 20, depth: int = 5, seed: int = 5, window: str = "window", targets: str = "targets",
) -> tuple[PCAModel, RandomForestRegressionModel, DataFrame]:
    """(PCA, forest, leaves) of one forest for all horizons. It learns from the windows that have all their targets.

    Trees are grown once, by Spark's forest, to part the windows by the mean of their targets. What a leaf predicts is not that
    one number but the mean vector of the targets of the training windows in it, leaves: (tree, leaf, n, means), at most
    trees x 2^depth rows, from one grouping by tree and leaf. Windows without all targets, or none, are left out.
    """
    rows = windows.where(F.col(window).isNotNull() & F.forall(targets, lambda t: t.isNotNull()))
    rows = rows.select(array_to_vector(F.col(window)).alias("x"), F.col(targets).alias("__y"), (F.aggregate(targets, F.lit(0.0), lambda a, t: a + t) / F.size(targets)).alias("__mean"))
    pca = PCA(k=k, inputCol="x", outputCol="features").fit(rows)
    train = pca.transform(rows).select("features", "__y", "__mean").persist()
    forest = RandomForestRegressor(featuresCol="features", labelCol="__mean", numTrees=trees, maxDepth=depth, seed=seed).setLeafCol("leaf").fit(train)
    each = leaf_rows(forest.transform(train).select("leaf", "__y"), ["__y"]).select("tree", "leaf", F.posexplode("__y").alias("horizon", "y"))
    means = each.groupBy("tree", "leaf", "horizon").agg(F.avg("y").alias("mean"), F.count("*").alias("n"))
    leaves = means.groupBy("tree", "leaf").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("horizon", "mean"))).alias("__m"))
    leaves = leaves.select("tree", "leaf", "n", F.transform("__m", lambda m: m["mean"]).alias("means")).toArrow()
    train.unpersist()
    return pca, forest, windows.sparkSession.createDataFrame(leaves)  # a part of the model, of the trees' size


def leaf_rows(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree, leaf): the leaf that each tree puts a row in."""
    return scored.select(*keys, F.posexplode(vector_to_array("leaf")).alias("tree", "__leaf")).select(*keys, "tree", F.col("__leaf").cast("int").alias("leaf"))


def score_forest(
    rows: DataFrame, pca: PCAModel, forest: RandomForestRegressionModel, leaves: DataFrame, keys: list[str], z: float = 1.96, window: str = "window",
) -> DataFrame:
    """(keys, horizon, mean, std, lower, upper): mean and population spread over the trees' leaves, in one pass over the rows.
    keys must tell rows apart; the leaves' table is broadcast, its size is bounded by the forest's."""
    features = pca.transform(rows.where(F.col(window).isNotNull()).withColumn("x", array_to_vector(F.col(window))))
    own = leaf_rows(forest.transform(features), keys).join(F.broadcast(leaves), ["tree", "leaf"])
    each = own.select(*keys, F.posexplode("means").alias("horizon", "v")).groupBy(*keys, "horizon").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return each.withColumn("lower", F.col("mean") - z * F.col("std")).withColumn("upper", F.col("mean") + z * F.col("std"))


def rf_forecast(
    windows: DataFrame, k: int = 8, trees: int = 20, depth: int = 5, ahead: int = 6,
    keys: list[str] = ["series", "date"], seed: int = 5, z: float = 1.96,
) -> DataFrame:  # noqa: B006
    """(keys, horizon, mean, std, lower, upper) for windows (flat array) whose targets are not known yet.

    PCA of the flattened window, one forest for all horizons, leaves that hold a mean for each; the spread is that of the
    trees. Learns from the windows with all their targets and scores those without; rows without a window are left out.
    """
    pca, forest, leaves = grow_forest(windows, k, trees, depth, seed)
    score = windows.where(F.col("window").isNotNull() & ~F.forall("targets", lambda t: t.isNotNull()))
    return score_forest(score, pca, forest, leaves, keys, z).where(F.col("horizon") < ahead)
