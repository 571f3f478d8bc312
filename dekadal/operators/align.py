"""Irregular observations onto the dekadal calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal

KEYS = ["series"]


def asof_dekad(obs: DataFrame, spine: DataFrame | None = None, time: str = "ts", strict: bool = True, name: str = "dekad") -> DataFrame:
    """The latest dekad strictly before each observation (with strict=False: at or before it).

    Closed form, no join. With a spine, dekads are clamped to it: later observations go to its last dekad, and those
    at or before its first one get null. The spine's two bounds are one row, so the join is a broadcast of one row.
    """
    at = F.col(time).cast("timestamp")
    found = obs.withColumn(name, cal.dekad_start(at - F.expr("interval 1 microsecond") if strict else at))
    if spine is None:
        return found
    ends = spine.agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    clamped = F.when(F.col(name) < F.col("__lo"), None).otherwise(F.least(F.col(name), F.col("__hi")))
    return found.crossJoin(F.broadcast(ends)).withColumn(name, clamped).drop("__lo", "__hi")


def asof_calendar(obs: DataFrame, calendar: DataFrame, time: str = "ts", strict: bool = True, name: str = "dekad") -> DataFrame:
    """As asof_dekad for any calendar of dates; before its first date there is none. Marks are dates, so what an observation
    gets follows from its own date and from whether it is later than midnight: a table of the days that occur, which a
    window carries the marks along, is joined by date. That window has a row per day, however many observations there are."""
    day = F.to_date(time)
    marks = calendar.select(F.col("date").alias("__mark")).where("__mark is not null").distinct()
    days = obs.select(day.alias("__day")).where("__day is not null").union(marks.select("__mark")).distinct()
    w = Window.orderBy("__day")
    known = days.join(marks, F.col("__day") == F.col("__mark"), "left")
    upto = F.last("__mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto")
    before = F.last("__mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before")
    carried = known.select("__day", upto, before)
    first = F.col(time).cast("timestamp") == F.col("__day").cast("timestamp")
    value = F.when(first & F.lit(strict), F.col("__before")).otherwise(F.col("__upto"))
    found = obs.where(F.col(time).isNotNull()).withColumn("__own", day).join(carried, F.col("__own") == F.col("__day"))
    return found.withColumn(name, value).drop("__own", "__day", "__upto", "__before")


def daily_mean(obs: DataFrame, keys: list[str] = KEYS, time: str = "ts", value: str = "value") -> DataFrame:
    return obs.groupBy(*keys, F.to_date(time).alias("date")).agg(F.avg(value).alias(value))


def dekad_mean(obs: DataFrame, keys: list[str] = KEYS, value: str = "value", dekad: str = "dekad") -> DataFrame:
    """Mean per assigned dekad; observations without one drop out."""
    return obs.where(F.col(dekad).isNotNull()).groupBy(*keys, F.col(dekad).alias("date")).agg(F.avg(value).alias(value))


def align_to_spine(means: DataFrame, spine: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """A row for every series and dekad of the spine, null where nothing was observed."""
    grid = means.select(*keys).distinct().crossJoin(F.broadcast(spine))
    return grid.join(means.select(*keys, "date", value), [*keys, "date"], "left")


def merge_indices(frames: dict[str, DataFrame], on: tuple[str, ...] = ("date_represented", "date_reported")) -> DataFrame:
    """Full outer join of tables with distinct value columns, as one union and one aggregation: one shuffle for any
    number of tables. Of rows that repeat a key in one table, the largest value stays."""
    values = [c for df in frames.values() for c in df.columns if c not in on]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())
    return rows.groupBy(*on).agg(*[F.max(v).alias(v) for v in values])


def join_sections(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("year", "month")) -> DataFrame:
    return a.join(b, list(on))


def assemble_features(frames: dict[str, DataFrame], time: str = "date", value: str = "value") -> DataFrame:
    """Full outer join by date of series tables (date, value), one column each: a long union and one pivot."""
    long = reduce(DataFrame.unionByName, [df.select(time, F.col(value).alias("__v"), F.lit(n).alias("__f")) for n, df in frames.items()])
    return long.groupBy(time).pivot("__f", list(frames)).agg(F.first("__v", ignorenulls=True))


def pivot_features(long: DataFrame, features: list[str], time: str = "date", name: str = "series", value: str = "value") -> DataFrame:
    return long.groupBy(time).pivot(name, features).agg(F.first(value, ignorenulls=True))


def representation_dates(df: DataFrame, dated: bool) -> DataFrame:
    """(date_represented, date_reported) from year, month and, where dated, day. Monthly values stand for day 25 and are
    reported a month later, dated ones five days later."""
    day = F.col("day") if dated else F.lit(25)
    at = F.make_date("year", "month", day)
    reported = F.date_add(at, 5) if dated else F.add_months(at, 1)
    return df.withColumn("date_represented", at).withColumn("date_reported", reported).drop("year", "month", "day")


def unpivot_months(df: DataFrame, value: str, year: str = "YEAR") -> DataFrame:
    """Twelve month columns to rows (year, month, value)."""
    names = [c for c in df.columns if c.strip().upper() in cal.MONTH_NAMES]
    long = df.unpivot([year], names, "month", value)
    return long.select(F.col(year).alias("year"), cal.month_name_num("month").alias("month"), value)


def align_files(dates: DataFrame, files: DataFrame, time: str = "date") -> DataFrame:
    """Dates with their file, null where it is missing."""
    return dates.join(files, time, "left").withColumn("missing", F.col("file").isNull())


def union_history(history: DataFrame, fresh: DataFrame) -> DataFrame:
    return history.unionByName(fresh, allowMissingColumns=True)


def new_dates_only(df: DataFrame, history: DataFrame, time: str = "date", keys: list[str] = []) -> DataFrame:  # noqa: B006
    return df.join(history.select(*keys, time).distinct(), [*keys, time], "left_anti")


def except_dates(df: DataFrame, history: DataFrame, time: str = "date") -> DataFrame:
    """Distinct dates that the history lacks."""
    return df.select(time).distinct().join(history.select(time).distinct(), time, "left_anti")


def align_lengths(a: DataFrame, b: DataFrame, time: str = "date") -> tuple[DataFrame, DataFrame]:
    """Both tables on the dates that both have."""
    return a.join(b.select(time).distinct(), time, "left_semi"), b.join(a.select(time).distinct(), time, "left_semi")


def study_period(df: DataFrame, time: str = "date", start: str = cal.EPOCH) -> DataFrame:
    return df.where(F.col(time) >= F.lit(start).cast("date"))


def past_only(df: DataFrame, as_of: Column, time: str = "date") -> DataFrame:
    return df.where(F.col(time) <= as_of)


def drop_incomplete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in any column (of the subset)."""
    return df.dropna("any", subset=subset)


def select_rename(df: DataFrame, names: dict[str, str], prefix: str = "") -> DataFrame:
    """Columns of interest under new names; the prefix goes before the new ones."""
    return df.select(*[F.col(f"`{old}`").alias(prefix + new if prefix and new == old else new) for old, new in names.items()])


def sentinel_to_null(df: DataFrame, cols: list[str], values: list) -> DataFrame:
    """Listed values become null; so does NaN, which Spark's averages would otherwise spread."""
    out = df
    for c in cols:
        v = F.col(c)
        bad = v.isin(*values) | (F.isnan(v) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
        out = out.withColumn(c, F.when(~bad, v))
    return out


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what is no number is null."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in cols})


def sort_by_date(df: DataFrame, time: str = "date", keys: list[str] = []) -> DataFrame:  # noqa: B006
    return df.orderBy(time, *keys)
