"""Normalisation: by the first rows of a series, by season, by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalar import safe_divide

#: Rows that the scaler learns from.
SCALER_ROWS = 804


def fit_scaler(
    df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value", first_n: int = SCALER_ROWS,
) -> DataFrame:  # noqa: B006
    """Mean and population standard deviation of the first rows of each series."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= first_n).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def stats_lookup(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the mean and std of their key; rows without statistics drop out. Spark broadcasts small statistics."""
    return df.join(stats.select(*on, "mean", "std"), on)


def zscore(df: DataFrame, stats: DataFrame, on: list[str] = ["series"], value: str = "value") -> DataFrame:  # noqa: B006
    """(value - mean) / std; a std of 0 divides by 1."""
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return stats_lookup(df, stats, on).withColumn(value, (F.col(value) - F.col("mean")) / std).drop("mean", "std")


def unscale(df: DataFrame, stats: DataFrame, on: list[str] = ["series"], value: str = "value") -> DataFrame:  # noqa: B006
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return stats_lookup(df, stats, on).withColumn(value, F.col(value) * std + F.col("mean")).drop("mean", "std")


def seasonal_stats(df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value") -> DataFrame:  # noqa: B006
    """Mean and sample standard deviation per series and month-day."""
    return df.groupBy(*keys, cal.month_day(time).alias("month_day")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def seasonal_lookup(df: DataFrame, stats: DataFrame, keys: list[str] = ["series"], time: str = "date") -> DataFrame:  # noqa: B006
    """Rows with the statistics of their month-day; null where there are none."""
    return df.withColumn("month_day", cal.month_day(time)).join(stats, [*keys, "month_day"], "left")


def seasonal_zscore(
    df: DataFrame, stats: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value",
) -> DataFrame:  # noqa: B006
    """z-score by month-day: std 0 gives 0, no statistics leave the value; rows that are null then are dropped."""
    rows = seasonal_lookup(df, stats, keys, time)
    z = F.when(F.col("mean").isNull() & F.col("std").isNull(), F.col(value)).when(F.col("std") == 0, F.lit(0.0)).otherwise(safe_divide(F.col(value) - F.col("mean"), F.col("std")))
    return rows.withColumn(value, z).drop("mean", "std", "month_day").where(F.col(value).isNotNull())


def cumulative_anomaly(df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value") -> DataFrame:  # noqa: B006
    """Running sum of z-scores (sample deviation of the whole series); null where the value is."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    z = safe_divide(F.col(value) - F.avg(value).over(whole), F.stddev_samp(value).over(whole))
    rows = df.withColumn("__z", z)
    return rows.withColumn("cumulative", F.when(F.col(value).isNotNull(), F.sum("__z").over(run))).drop("__z")
