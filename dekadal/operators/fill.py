"""Gaps: linear inside, a trend at the ends. Windows are by series, so one task holds one series, never the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate_linear(df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value") -> DataFrame:  # noqa: B006
    """Linear by row position between the nearest present values; leading and trailing gaps stay null."""
    w = Window.partitionBy(*keys).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col(value)
    place = F.row_number().over(w)
    rows = df.withColumn("__i", place)
    here = F.when(v.isNotNull(), F.struct(F.col("__i").alias("i"), v.alias("v")))
    rows = rows.withColumn("__a", F.last(here, ignorenulls=True).over(back)).withColumn("__b", F.first(here, ignorenulls=True).over(ahead))
    slope = (F.col("__b.v") - F.col("__a.v")) / F.nullif(F.col("__b.i") - F.col("__a.i"), F.lit(0))
    inside = F.col("__a.v") + slope * (F.col("__i") - F.col("__a.i"))
    return rows.withColumn(value, F.coalesce(v, inside)).drop("__i", "__a", "__b")


def missing_runs(df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value") -> DataFrame:  # noqa: B006
    """Runs of consecutive nulls: first and last date, length, and whether the run is leading, inside or trailing."""
    w = Window.partitionBy(*keys).orderBy(time)
    all_rows = Window.partitionBy(*keys)
    marked = df.withColumn("__p", F.count(value).over(w)).withColumn("__n", F.count(value).over(all_rows)).where(F.col(value).isNull())
    runs = marked.groupBy(*keys, F.col("__p"), F.col("__n")).agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.count("*").cast("int").alias("length"))
    kind = F.when(F.col("__p") == 0, "leading").when(F.col("__p") == F.col("__n"), "trailing").otherwise("inside")
    return runs.withColumn("kind", kind).drop("__p", "__n")


def trend_fit(
    df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value", n: int = 6,
    as_of: Column | None = None,
) -> DataFrame:  # noqa: B006
    """Least-squares line through the last n present values, at t = 0 .. n-1; series with fewer values have none."""
    past = df if as_of is None else df.where(F.col(time) <= as_of)
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    last = past.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    t = (F.lit(n) - F.col("__r")).cast("double")
    return last.groupBy(*keys).agg(F.regr_slope(F.col(value), t).alias("slope"), F.regr_intercept(F.col(value), t).alias("intercept"), F.count("*").alias("__c")).where(F.col("__c") == n).drop("__c")


def trend_extrapolate(
    df: DataFrame, keys: list[str] = ["series"], time: str = "date", value: str = "value", n: int = 6,
    as_of: Column | None = None, where: str = "all",
) -> DataFrame:  # noqa: B006
    """Remaining gaps filled from the trend: the k-th missing row, in date order, is at t = n - 1 + k.

    ``where='trailing'`` leaves leading gaps. Rows after as_of are not touched. The fit is a row per series. A series is a
    task's work: a row per date. Without keys the table is one series, with one row of fit.
    """
    fit = trend_fit(df, keys, time, value, n, as_of)
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.col(value).isNull()
    if as_of is not None:
        gap = gap & (F.col(time) <= as_of)
    rows = df
    if where == "trailing":
        rows = rows.withColumn("__seen", F.count(value).over(w))
        gap = gap & (F.col("__seen") > 0)
    rows = rows.withColumn("__k", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    filled = rows.join(fit, keys, "left") if keys else rows.crossJoin(fit)
    line = F.col("intercept") + F.col("slope") * (F.lit(n - 1) + F.col("__k"))
    return filled.withColumn(value, F.when(gap, line).otherwise(F.col(value))).drop("__k", "__seen", "slope", "intercept")
