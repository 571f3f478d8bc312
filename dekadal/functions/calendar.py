"""The dekadal calendar: days 1, 11 and 21 of each month begin a dekad. Columns in, columns out, or small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that the study period, and so every default calendar, begins with.
EPOCH = "2002-07-01"
TIMESTEPS = ("daily", "pentadal", "dekadal", "monthly", "seasonal")
# Season codes of three months by their middle month, and month names.
SEASON_CODES = "DJF JFM FMA MAM AMJ MJJ JJA JAS ASO SON OND NDJ".split()
MONTH_NAMES = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dekad_no(c: Column | str) -> Column:
    return F.least(F.floor((F.dayofmonth(col(c)) + 9) / 10), F.lit(3)).cast("int")


def pentad_no(c: Column | str) -> Column:
    return F.least(F.floor((F.dayofmonth(col(c)) + 4) / 5), F.lit(6)).cast("int")


def dekad_start(c: Column | str) -> Column:
    return F.date_add(F.trunc(col(c), "MM"), (dekad_no(c) - 1) * 10)


def dekad_end(c: Column | str) -> Column:
    return F.when(dekad_no(c) < 3, F.date_add(dekad_start(c), 9)).otherwise(F.last_day(col(c)))


def dekad_index(c: Column | str) -> Column:
    """Dekads since year 0; differences count dekads."""
    return F.year(col(c)) * 36 + (F.month(col(c)) - 1) * 3 + dekad_no(c) - 1


def dekad_of_index(i: Column) -> Column:
    i = i.cast("int")
    return F.make_date(F.floor(i / 36).cast("int"), (F.floor(F.pmod(i, F.lit(36)) / 3) + 1).cast("int"), (F.pmod(i, F.lit(3)) * 10 + 1).cast("int"))


def season(c: Column | str) -> Column:
    m = F.month(col(c))
    return F.when(m.isin(12, 1, 2), "DJF").when(m < 6, "MAM").when(m < 9, "JJA").otherwise("SON")


def month_day(c: Column | str) -> Column:
    return F.date_format(col(c), "MM-dd")


def is_period_end(c: Column | str, timestep: str) -> Column:
    """Whether the date is the last day of its period."""
    d = col(c)
    last = d == F.last_day(d)
    if timestep == "daily":
        return F.lit(True)
    if timestep == "pentadal":
        return last | F.dayofmonth(d).isin(5, 10, 15, 20, 25)
    if timestep == "dekadal":
        return last | F.dayofmonth(d).isin(10, 20)
    if timestep == "monthly":
        return last
    if timestep == "seasonal":
        return last & F.month(d).isin(2, 5, 8, 11)
    raise ValueError(f"unknown timestep: {timestep}")


def days_between(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """All days from a one-row table of bounds, both inclusive."""
    return bounds.where(f"{start} <= {end}").select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))).alias("date"))


def bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def bounds_of(df: DataFrame, time: str) -> DataFrame:
    """First and last day of a table, as a one-row table."""
    return df.agg(F.min(time).cast("date").alias("start"), F.max(time).cast("date").alias("end"))


def month_end_extend(df: DataFrame, end: str = "end") -> DataFrame:
    return df.withColumn(end, F.last_day(end))


def daterange(spark: SparkSession, start: str, end: str, month_end: bool = False) -> DataFrame:
    b = bounds(spark, start, end)
    return days_between(month_end_extend(b) if month_end else b)


def spine_of(bounds_row: DataFrame) -> DataFrame:
    """The dekads that begin between two days, from a one-row table; month starts first, so a century is 1200 rows."""
    months = bounds_row.where("start <= end").select("start", "end", F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))).alias("m"))
    dekads = months.select("start", "end", F.explode(F.array("m", F.date_add("m", 10), F.date_add("m", 20))).alias("date"))
    return dekads.where("date between start and end").select("date")


def dekad_spine(spark: SparkSession, start: str = EPOCH, end: str | None = None) -> DataFrame:
    if end is None:
        raise ValueError("end is needed: no operator reads the clock")
    return spine_of(bounds(spark, start, end))


def future_dekads(history: DataFrame, n: int = 6, time: str = "date", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The n dekads after the last one (of each key)."""
    last = history.groupBy(*keys).agg(F.max(time).alias("__last"))
    after = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((k - 1).alias("horizon"), dekad_of_index(dekad_index("__last") + k).alias("date")))
    return last.select(*keys, F.inline(after))


def new_data_due(history: DataFrame, as_of: DataFrame, time: str = "date") -> DataFrame:
    """One row: whether a completed dekad is missing. as_of is a one-row table (as_of); the newest dekad that has begun
    by then is not yet complete."""
    row = history.agg(F.max(time).alias("last")).crossJoin(F.broadcast(as_of))
    begun = dekad_index("as_of") - dekad_index("last")
    return row.select("last", F.greatest(begun, F.lit(0)).cast("int").alias("n_begun"), (begun > 1).alias("due"))


def offset_to_date(first: Column | str, offset: Column | str) -> Column:
    return F.date_add(col(first), col(offset).cast("int"))


def calendar_days(days: DataFrame) -> DataFrame:
    """A daily calendar with the numbers of its periods."""
    d = F.col("date")
    return days.select("date", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.dayofyear(d).alias("doy"), pentad_no(d).alias("pentad"), dekad_no(d).alias("dekad"), season(d).alias("season"))


def period_start(c: Column | str, timestep: str) -> Column:
    d = col(c)
    month = F.trunc(d, "MM")
    if timestep == "daily":
        return d.cast("date")
    if timestep == "pentadal":
        return F.date_add(month, (pentad_no(d) - 1) * 5)
    if timestep == "dekadal":
        return dekad_start(d)
    if timestep == "monthly":
        return month
    if timestep == "seasonal":
        return F.add_months(month, -F.pmod(F.month(d), F.lit(3)))
    raise ValueError(f"unknown timestep: {timestep}")


def period_runs(days: DataFrame, timestep: str) -> DataFrame:
    """Runs of days of one period: first day, last day, length. A period that the days cut short is a shorter run."""
    return days.groupBy(period_start("date", timestep).alias("period")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").cast("int").alias("length"))


def season_complete(runs: DataFrame) -> DataFrame:
    """Seasons with all their days; the expected length follows the calendar, leap years included."""
    expected = F.date_diff(F.add_months("period", 3), F.col("period"))
    return runs.where(F.col("length") >= expected)


def period_calendar(days: DataFrame, timestep: str) -> DataFrame:
    """One row per period with all of its days at the end; an unfinished last period is left out, and so are seasons
    that lack days."""
    runs = period_runs(days, timestep)
    if timestep == "seasonal":
        runs = season_complete(runs)
    done = runs.where(is_period_end("end_date", timestep))
    d = F.col("start_date")
    return done.select("start_date", "end_date", "length", F.year(d).alias("year"), F.month(d).alias("month"), pentad_no(d).alias("pentad"), dekad_no(d).alias("dekad"), season(d).alias("season"))


def season_code_month(c: Column | str) -> Column:
    """DJF -> 1 ... NDJ -> 12; null for other codes."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEASON_CODES)), F.upper(F.trim(col(c)))), F.lit(0)).cast("int")


def month_name_num(c: Column | str) -> Column:
    """JAN -> 1 ... DEC -> 12; null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.upper(F.trim(col(c)))), F.lit(0)).cast("int")


def split_yyyymmdd(c: Column | str) -> list[Column]:
    s = col(c).cast("string")
    return [s.substr(a, n).try_cast("int").alias(name) for a, n, name in ((1, 4, "year"), (5, 2, "month"), (7, 2, "day"))]


def parse_file_date(c: Column | str) -> Column:
    """The date in a raster's file name: digits of its last _ part; null for other files, odd dates and numbered copies."""
    name = col(c)
    token = F.regexp_replace(F.element_at(F.split(name, "_"), -1), "[^0-9]", "")
    return F.when(F.lower(name).endswith(".tif") & ~name.rlike(r"\(\d+\)"), F.try_to_date(token, "yyyyMMdd"))
