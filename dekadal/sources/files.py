"""File listings and manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal


def list_rasters(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, file, date) of the rasters in a folder, sorted. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), cal.parse_file_date(name).alias("date")).orderBy("path")


# How the public archive names its files.
SUFFIX = {"daily": "_{day}", "pentadal": "-pt{pentad}", "dekadal": "-dk{dekad}", "monthly": "", "seasonal": "_seas"}
FULL_RESOLUTION = "0.0375"


def file_manifest(
    calendar: DataFrame, product: str = "rfe", timestep: str = "dekadal", version: str = "3.1",
    resolution: str = FULL_RESOLUTION, root: str = "", anomalies: bool = False,
) -> DataFrame:
    """(start_date, path) of the files expected for the periods of a calendar (period_calendar's columns).

    Products are rfe and sm; coarser resolutions of rfe are in a folder of their own and carry it in their names, sm has
    no such folders.
    """
    coarse = product == "rfe" and resolution != FULL_RESOLUTION
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    month, year = two("month"), F.col("year").cast("string")
    day = F.lpad(F.dayofmonth("start_date").cast("string"), 2, "0")
    number = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    suffixes = {"daily": F.concat(F.lit("_"), day), "monthly": F.lit(""), "seasonal": F.lit("_seas")}
    suffix: Column = {**suffixes, "pentadal": number("-pt", "pentad"), "dekadal": number("-dk", "dekad")}[timestep]
    name = F.concat(F.lit(product), year, F.lit("_"), month, suffix, F.lit("_anom" if anomalies else ""), F.lit(f"_{resolution}" if coarse else ""), F.lit(f".v{version}.nc"))
    data = "soil_moisture/data" if product == "sm" else "rfe/data_degraded" if coarse else "rfe/data"
    folder = f"{root}{data}/v{version}/{timestep}{'-anomalies' if anomalies else ''}/" + (f"{resolution}/" if coarse else "")
    return calendar.select("start_date", F.concat(F.lit(folder), year, F.lit("/"), month, F.lit("/"), name).alias("path"))


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected paths that are not there; the file name decides."""
    name = F.element_at(F.split("path", "/"), -1)
    return expected.withColumn("file", name).join(present.select(name.alias("file")).distinct(), "file", "left_anti").drop("file")


def latest_forecast(spark: SparkSession, base: str) -> DataFrame:
    """The table of the newest run below base: run folders are named <start>_to_<end>, and the end decides. The newest run is
    found among the names of files; no other run's file is opened. A run without exactly one CSV is an error."""
    from ..sources.readers import normalise_forecast_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(base).select("path")
    run = F.regexp_extract("path", r"/([0-9]{4}-[0-9]{2}-[0-9]{2}_to_[0-9]{4}-[0-9]{2}-[0-9]{2})/", 1)
    runs = files.select("path", run.alias("run")).where("run <> ''").groupBy("run").agg(F.count("*").alias("n"), F.max("path").alias("path"))
    newest = runs.orderBy(F.desc(F.split_part("run", F.lit("_to_"), F.lit(2))), F.desc("run")).limit(1).first()
    if newest is None or newest["n"] != 1:
        raise ValueError(f"one CSV expected in the latest run below {base}, found {newest['n'] if newest else 0}")
    return normalise_forecast_schema(spark.read.option("header", True).csv(newest["path"]))
