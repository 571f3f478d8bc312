"""Differences, rolling values, slices and supervised windows of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta(df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value") -> DataFrame:  # noqa: B006
    """First difference by date."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def rolling_min(
    df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value", n: int = 18,
) -> DataFrame:  # noqa: B006
    """Minimum of the last n rows by date, of fewer at the start."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - n, 0)
    return df.withColumn("rolling_min", F.min(value).over(w))


def last_n(df: DataFrame, keys: list[str], time: str = "date", n: int = 1) -> DataFrame:
    """The last n rows of each key by time. Without keys: a top-n sort, which moves n rows a task."""
    if not keys:
        return df.orderBy(F.desc(time)).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def recent_slices(
    df: DataFrame, keys: list[str] = ["series"], time: str = "date", sizes: tuple[int, ...] = (180, 36),
) -> DataFrame:  # noqa: B006
    """A row per slice that a row belongs to: 0 is the whole record, n the last n rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    ranked = df.withColumn("__r", F.row_number().over(w))
    slices = F.filter(F.array(F.lit(0), *map(F.lit, sizes)), lambda n: (n == 0) | (F.col("__r") <= n))
    return ranked.withColumn("slice", F.explode(slices)).drop("__r")


def year_overlay(df: DataFrame, time: str = "date", predicted: str | None = None) -> DataFrame:
    """Year, day of year and running number of the year. Numbers come from a table of the distinct years, so no window
    spans the table."""
    rows = df.withColumn("year", F.year(time)).withColumn("doy", F.dayofyear(time)).withColumn("predicted", F.lit(False) if predicted is None else F.col(predicted))
    years = distinct_years(df, time)
    numbered = years.withColumn("year_index", (F.row_number().over(Window.orderBy("year")) - 1).cast("int"))  # a few hundred rows
    return rows.join(F.broadcast(numbered), "year")


def distinct_years(df: DataFrame, time: str = "date") -> DataFrame:
    return df.select(F.year(time).alias("year")).distinct()


def supervised_windows(
    df: DataFrame, features: list[str], look_back: int = 36, ahead: int = 6, keys: list[str] = ["series"],
    time: str = "date", target: str | None = None, complete: bool = True,
) -> DataFrame:  # noqa: B006
    """One row per key and date with the last look_back rows of the features as an array of arrays, oldest first, and
    the next ``ahead`` targets. complete keeps only full look-backs; targets beyond the data are null."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w.rowsBetween(1 - look_back, 0))
    out = df.withColumn("window", rows)
    if target:
        out = out.withColumn("targets", F.array(*[F.lead(target, k).over(w) for k in range(1, ahead + 1)]))
    if complete:
        out = out.where(F.size("window") == look_back)
    return out.select(*keys, time, "window", *(["targets"] if target else []))
