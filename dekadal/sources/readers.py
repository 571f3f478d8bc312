"""Text sources with explicit schemas. What does not parse is null, never an error; NaN is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.grid import series_of_points
from ..operators.region import union_regions

#: Values that altimeter files hold where nothing was measured.
ALTIMETER_SENTINELS = (999.99, 99.999)


def number(c: Column) -> Column:
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def read_series_csv(spark: SparkSession, path: str, schema: str, time: str = "date") -> DataFrame:
    """CSV with a header and a date column."""
    return spark.read.schema(schema).option("header", True).csv(path).where(F.col(time).isNotNull())


def read_altimeter(spark: SparkSession, path: str, value_name: str = "value") -> DataFrame:
    """(ts, value) of white-space text: mission, cycle, yyyymmdd, hour, minute, height variation, and more columns.
    Header lines are those whose third part is no date; sentinels are null."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 6)
    v = number(F.col("p")[5])
    return rows.select(F.try_to_date(F.col("p")[2], "yyyyMMdd").alias("ts"), F.when(~v.isin(*ALTIMETER_SENTINELS), v).alias(value_name)).where("ts is not null")


def read_hydro_product(spark: SparkSession, path: str, value_name: str = "value") -> DataFrame:
    """(ts, value) of text with semicolons: decimal year, date, time, height, and more columns; the mean per date."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 4)
    day = F.try_to_date(F.trim(F.col("p")[1]), "yyyy/MM/dd")
    iso = F.try_to_date(F.trim(F.col("p")[1]), "yyyy-MM-dd")
    return rows.select(F.coalesce(day, iso).alias("ts"), number(F.col("p")[3]).alias(value_name)).where("ts is not null").groupBy("ts").agg(F.avg(value_name).alias(value_name))


def read_rainfall_products(spark: SparkSession, path: str, products: tuple[str, ...] = ("TAMSAT", "CHIRPS")) -> DataFrame:
    """(series, ts, value) of a daily CSV with a time column and one column per product."""
    rows = spark.read.option("header", True).csv(path)
    long = rows.select(F.to_timestamp(F.col("time").try_cast("timestamp")).alias("ts"), F.expr(f"stack({len(products)}, {', '.join(f"'{p}', {p}" for p in products)}) as (series, raw)"))
    return long.select("series", "ts", number(F.col("raw")).alias("value")).where("ts is not null")


def read_climate_index(
    spark: SparkSession, path: str, kind: str, columns: list[str] = [], prefix: str | None = None,
) -> DataFrame:  # noqa: B006
    """One index file. kind: season (YR SEAS values), monthly (YR MON values), pentad (yyyymmdd values), dipole (Year Month
    values). Values get the prefix; lines that begin with no year are headers; starred values are null (a pentad row
    with one is dropped). columns name the values in order."""
    parts = F.split(F.trim("value"), r"\s+")
    p = F.col("p")
    rows = spark.read.text(path).select(parts.alias("p")).where(p[0].rlike(r"^\d{4}(\d{4})?$"))
    first = 1 if kind == "pentad" else 2
    prefix = prefix if prefix is not None else {"season": "oni", "monthly": "nino", "pentad": "mjo", "dipole": "dmi"}[kind]
    values = [number(F.get(p, F.lit(first + i))).alias(f"{prefix}_{c}") for i, c in enumerate(columns)]
    if kind == "season":
        keys = [p[0].try_cast("int").alias("year"), cal.season_code_month(p[1]).alias("month")]
    elif kind in ("monthly", "dipole"):
        keys = [p[0].try_cast("int").alias("year"), F.get(p, F.lit(1)).try_cast("int").alias("month")]
    elif kind == "pentad":
        keys = cal.split_yyyymmdd(p[0])
        rows = rows.where(~F.exists("p", lambda v: v.startswith("***")))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return rows.select(*keys, *values).where("month is not null")


def read_sectioned_fwf(
    spark: SparkSession, path: str, markers: dict[str, str], widths: tuple[int, ...] = (4, *[6] * 12),
    missing: float = -999.9,
) -> DataFrame:
    """(section, YEAR, JAN ... DEC) of fixed-width files that hold several sections, each begun by a line with its marker
    (blanks left out). markers: name -> marker. A file is one row, so files are to be small, as such files are."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"), F.col("_metadata.file_path").alias("file"))
    bare = F.regexp_replace("line", r"\s", "")
    mark = reduce(lambda a, kv: F.when(bare.contains(kv[1]), F.lit(kv[0])).otherwise(a), sorted(markers.items(), key=lambda kv: len(kv[1])), F.lit(None).cast("string"))
    from pyspark.sql import Window

    section = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("i"))
    at = [1 + sum(widths[:k]) for k in range(len(widths))]
    fields = [F.substring("line", a, w) for a, w in zip(at, widths, strict=True)]
    values = [number(f) for f in fields[1:]]
    rows = lines.withColumn("section", section).where(fields[0].rlike(r"^\d{4}$") & F.col("section").isNotNull())
    return rows.select("section", fields[0].cast("int").alias("YEAR"), *[F.when(v != missing, v).alias(n) for n, v in zip(cal.MONTH_NAMES, values, strict=False)])


def read_cube(
    spark: SparkSession, path: str, variable: str | None = None, dates: tuple[str, str] | None = None,
    box: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """A stored cube, partitioned by variable and date: filters on both prune folders, a box (y0, y1, x0, x1) is pushed
    to the Parquet scan."""
    cube = spark.read.parquet(path)
    if variable is not None:
        cube = cube.where(F.col("variable") == variable)
    if dates is not None:
        cube = cube.where(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    if box is not None:
        cube = cube.where(f"y between {box[0]} and {box[1]} and x between {box[2]} and {box[3]}")
    return cube


def read_point_extract(spark: SparkSession, path: str, points: str, series: str) -> DataFrame:
    """A row per point and date of what sinks.extract_points_to_csv wrote. points and series: the schemas of its two tables,
    both with y and x."""
    placed, rows = (spark.read.schema(s).option("header", True).csv(f"{path.rstrip('/')}/{n}") for n, s in (("points", points), ("series", series)))
    return series_of_points(placed, rows)


def read_regions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Boundary layers stacked on their common columns."""
    return union_regions([spark.read.parquet(p) for p in paths])


def read_points(points: DataFrame, min_population: int = 10_000) -> DataFrame:
    """Places with a population of at least min_population; the label prefers the English name."""
    p = F.col("population").cast("string").try_cast("double")
    return points.select(F.coalesce("name_en", "name").alias("label"), p.cast("bigint").alias("population"), "x", "y").where(p >= min_population)


def normalise_forecast_schema(df: DataFrame) -> DataFrame:
    """Both published headers of forecast tables as (date, percent_inundation, lower_bound_95, upper_bound_95)."""
    have = set(df.columns)
    value = "percent_inundation_prediction" if "percent_inundation_prediction" in have else "percent_inundation"
    pick = lambda c: F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")
    date = next(c for c in ("date", "_c0", "index") if c in have)
    columns = {"percent_inundation": value, "lower_bound_95": "lower_bound_95", "upper_bound_95": "upper_bound_95"}
    return df.select(F.col(date).cast("string").try_cast("date").alias("date"), *[pick(c).alias(name) for name, c in columns.items()])
