"""Writers. Each can be repeated: a rerun replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalar import round4
from .staging import staging_dir


def write_series(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def append_cube(df: DataFrame, path: str) -> None:
    """New dates of a cube; dates that are there already are replaced, all others stay. Rows move to their date first, so
    that a date is one file and not one of each task; adaptive execution splits a large date."""
    overwrite_parts(df, path, ["variable", "date"])


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of those that share keys: the largest, by its other columns in their order, nulls least."""
    rest = [c for c in df.columns if c not in keys]
    if len(rest) == 1:  # the same, without sorting all rows by their keys
        return df.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*df.columns)
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__best")) if rest else df.distinct()
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def overwrite_parts(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the partitions that rows have, and no others. Rows move to their partition first, so that it is one file and
    not one of each task; adaptive execution splits a large one."""
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored, or an empty table of the schema where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upsert(df: DataFrame, path: str, keys: list[str], parts: list[str]) -> None:
    """Rows of a stored table: those whose keys come again are replaced, all others stay, those of the same partitions among
    them; of rows of df that share keys the largest counts. The partitions that df touches are put together in the
    shared folder, and then overwritten, so that a run that is repeated changes nothing."""
    spark, new = df.sparkSession, one_of_each(df, keys)
    touched = df.select(*parts).distinct()
    old = stored(spark, path, df.schema).join(touched, parts, "left_semi").join(new.select(*keys), keys, "left_anti")
    whole = staging_dir(spark, "merged")
    old.select(df.columns).union(new.select(df.columns)).write.parquet(whole)
    overwrite_parts(spark.read.schema(df.schema).parquet(whole), path, parts)


def merge_cube(df: DataFrame, path: str, keys: tuple[str, ...] = ("variable", "date", "y", "x")) -> None:
    """Cells of a stored cube: those that come again are replaced, all others stay, those of the same dates among them; of
    cells that df repeats the largest value stays."""
    upsert(df, path, list(keys), ["variable", "date"])


def refresh_tail(history: DataFrame, fresh: DataFrame, n: int = 18, time: str = "date") -> DataFrame:
    """History without its last n dekads, and the fresh rows from there on. n = 0 keeps all of the history; a full rebuild is
    the fresh rows alone."""
    last = history.agg(F.max(cal.dekad_index(time)).alias("__last"))
    index = cal.dekad_index(time)
    kept = history.crossJoin(F.broadcast(last)).where(index <= F.col("__last") - n).drop("__last")
    newer = fresh.crossJoin(F.broadcast(last)).where(index > F.coalesce(F.col("__last") - n, F.lit(-1))).drop("__last")
    return kept.unionByName(newer, allowMissingColumns=True)


def write_forecast(history: DataFrame, forecast: DataFrame, path: str) -> None:
    """History, then forecast, as one CSV in a folder <first>_to_<last> below path; the names come from the forecast."""
    rows = history.select("date", "percent_inundation").unionByName(forecast.select("date", "percent_inundation", "lower_bound_95", "upper_bound_95"), allowMissingColumns=True)
    ends = forecast.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    rows.coalesce(1).sortWithinPartitions("date").write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{ends['a']}_to_{ends['b']}")


def write_alert(alert: DataFrame, path: str) -> None:
    """A line of text per alert, in a file per partition; no alert, no line."""
    alert.where("alert").select(F.col("message").alias("value")).write.mode("overwrite").text(path)


def write_masks(masks: DataFrame, path: str) -> None:
    masks.select("y", "x", "flooded", "scenario").write.mode("overwrite").partitionBy("scenario").parquet(path)


def extract_to_csv(extract: DataFrame, path: str, value: str = "value") -> None:
    """Values to four places, half to even."""
    extract.withColumn(value, round4(F.col(value))).write.mode("overwrite").option("header", True).csv(path)


def extract_points_to_csv(cube: DataFrame, points: DataFrame, path: str, value: str = "value") -> None:
    """The extract of many points as two CSV tables that hold all of it: series, the rows of each cell that a point lies in,
    once, and points, with the cell (y, x) of each. Written out by point and date it has a copy of its cell's series for
    each point; readers.read_point_extract makes these rows. Values to four places, half to even."""
    cells = cube.join(points.select("y", "x").distinct(), ["y", "x"], "left_semi")
    extract_to_csv(cells, f"{path.rstrip('/')}/series", value)
    points.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/points")
