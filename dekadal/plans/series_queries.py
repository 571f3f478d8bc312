"""Queries on the calendar and on series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalar
from ..operators import align, features, fill, scale
from .bindings import ORACLE_SQL, PRICE, aligned, dk, filled, means, obs, query, r4, spine, sql, table

S = SparkSession


def dates(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


D = "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)\n"


@query(D + f"SELECT date, {dk('date')} AS dekad, (least((day(date) - 1) // 10, 2) + 1)::INT AS n, (CASE WHEN day(date) > 20 THEN last_day(date) ELSE {dk('date')} + 9 END)::DATE AS dekad_end, least((day(date) - 1) // 5, 5)::INT + 1 AS pentad FROM d")
def dekad_start(spark: S, sf: str) -> DataFrame:
    return dates(spark, sf).select("date", cal.dekad_start("date").alias("dekad"), cal.dekad_no("date").alias("n"), cal.dekad_end("date").alias("dekad_end"), cal.pentad_no("date").alias("pentad"))


@query(sql("spine", "SELECT date FROM spine").replace("obs AS", "obs AS"))
def dekad_spine(spark: S, sf: str) -> DataFrame:
    return spine(spark, sf)


@query("SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, last_day(max(o_orderdate))::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM orders")
def daterange(spark: S, sf: str) -> DataFrame:
    return cal.days_between(cal.month_end_extend(cal.bounds_of(table(spark, sf, "orders"), "o_orderdate")))


@query("SELECT DISTINCT o_orderdate::DATE AS date, last_day(o_orderdate)::DATE AS month_end FROM orders")
def month_end_extend(spark: S, sf: str) -> DataFrame:
    return cal.month_end_extend(dates(spark, sf).withColumn("month_end", F.col("date")), "month_end")


@query("SELECT DISTINCT l_shipdate::DATE AS date, strftime(l_shipdate, '%m-%d') AS month_day FROM lineitem")
def month_day(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().withColumn("month_day", cal.month_day("date"))


@query("SELECT o_orderkey, (date_trunc('year', o_orderdate)::DATE + (o_orderkey % 400)::INT)::DATE AS date FROM orders")
def offset_to_date(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", cal.offset_to_date(F.trunc("o_orderdate", "year"), F.col("o_orderkey") % 400).alias("date"))


@query(D + """SELECT date, date = last_day(date) OR day(date) IN (5, 10, 15, 20, 25) AS pentadal, date = last_day(date) OR day(date) IN (10, 20) AS dekadal,
    date = last_day(date) AS monthly, date = last_day(date) AND month(date) IN (2, 5, 8, 11) AS seasonal FROM d""")
def is_period_end(spark: S, sf: str) -> DataFrame:
    return dates(spark, sf).select("date", *[cal.is_period_end("date", t).alias(t) for t in cal.TIMESTEPS[1:]])


ALL_DAYS = "a AS (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM orders)"
START = {
    "pentadal": "date_trunc('month', date)::DATE + (least((day(date) - 1) // 5, 5) * 5)::INT",
    "dekadal": dk("date"),
    "monthly": "date_trunc('month', date)::DATE",
    "seasonal": "(date_trunc('month', date) - to_months(((month(date) % 3))::INT))::DATE",
}


def days(spark: S, sf: str) -> DataFrame:
    return cal.days_between(cal.bounds_of(table(spark, sf, "orders"), "o_orderdate"))


RUNS = " UNION ALL ".join(f"SELECT '{t}' AS timestep, {e} AS period, min(date) AS start_date, max(date) AS end_date, count(*)::INT AS length FROM a GROUP BY period" for t, e in START.items())


@query(f"WITH {ALL_DAYS} {RUNS}")
def period_runs(spark: S, sf: str) -> DataFrame:
    parts = [cal.period_runs(days(spark, sf), t).select(F.lit(t).alias("timestep"), "period", "start_date", "end_date", "length") for t in START]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""WITH {ALL_DAYS}, r AS ({RUNS}) SELECT timestep, start_date, end_date, length, year(start_date)::INT AS year, month(start_date)::INT AS month,
    (least((day(start_date) - 1) // 5, 5) + 1)::INT AS pentad, (least((day(start_date) - 1) // 10, 2) + 1)::INT AS dekad,
    CASE WHEN month(start_date) IN (12, 1, 2) THEN 'DJF' WHEN month(start_date) < 6 THEN 'MAM' WHEN month(start_date) < 9 THEN 'JJA' ELSE 'SON' END AS season FROM r
    WHERE (timestep <> 'seasonal' OR length >= date_diff('day', period, (period + INTERVAL 3 MONTH)::DATE)) AND (end_date = last_day(end_date) OR (timestep = 'pentadal' AND day(end_date) % 5 = 0 AND day(end_date) <= 25) OR (timestep = 'dekadal' AND day(end_date) IN (10, 20)))""")
def period_calendar(spark: S, sf: str) -> DataFrame:
    parts = [cal.period_calendar(days(spark, sf), t).withColumn("timestep", F.lit(t)) for t in START]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {ALL_DAYS}, r AS ({RUNS}) SELECT period, start_date, end_date, length FROM r WHERE timestep = 'seasonal' AND length >= date_diff('day', period, (period + INTERVAL 3 MONTH)::DATE)")
def season_complete(spark: S, sf: str) -> DataFrame:
    return cal.season_complete(cal.period_runs(days(spark, sf), "seasonal"))


@query(sql("means", """, l AS (SELECT series, max(date) AS last FROM means GROUP BY series), g AS (SELECT unnest(generate_series(DATE '1990-01-01'::TIMESTAMP, DATE '2015-01-01'::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date)
    SELECT series, (r - 1)::INT AS horizon, date FROM (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS r FROM l JOIN g ON date > last AND day(date) IN (1, 11, 21)) WHERE r <= 6""").replace("\n, l AS", ",\n l AS"))
def future_dekads(spark: S, sf: str) -> DataFrame:
    return cal.future_dekads(means(spark, sf), keys=["series"])


@query(f"""WITH h AS (SELECT max({dk('o_orderdate')}) AS last FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT max(o_orderdate)::DATE AS as_of FROM orders),
    b AS (SELECT last, as_of, (year(as_of) * 36 + month(as_of) * 3 + least((day(as_of) - 1) // 10, 2)) - (year(last) * 36 + month(last) * 3 + least((day(last) - 1) // 10, 2)) AS n FROM h, a)
    SELECT last, greatest(n, 0)::INT AS n_begun, n > 1 AS due FROM b""")
def new_data_due(spark: S, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    history = orders.where("o_orderstatus = 'O'").select(cal.dekad_start("o_orderdate").alias("date"))
    as_of = orders.agg(F.max("o_orderdate").cast("date").alias("as_of"))
    return cal.new_data_due(history, as_of)


@query("""WITH c AS (SELECT o_orderkey, ['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'][month(o_orderdate)] AS code FROM orders)
    SELECT o_orderkey, code, list_position(['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'], code)::INT AS month FROM c""")
def season_code_month(spark: S, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, cal.SEASON_CODES)), F.month("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", code.alias("code")).withColumn("month", cal.season_code_month("code"))


@query("SELECT o_orderkey, upper(strftime(o_orderdate, '%b')) AS name, month(o_orderdate)::INT AS month FROM orders")
def month_name_num(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.upper(F.date_format("o_orderdate", "MMM")).alias("name")).withColumn("month", cal.month_name_num("name"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day FROM orders")
def split_yyyymmdd(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", *cal.split_yyyymmdd(F.date_format("o_orderdate", "yyyyMMdd")))


@query("""SELECT o_orderkey, o_orderdate::DATE AS date_represented, (o_orderdate::DATE + 5)::DATE AS date_reported, 'dated' AS kind FROM orders
    UNION ALL SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 25), (make_date(year(o_orderdate), month(o_orderdate), 25) + INTERVAL 1 MONTH)::DATE, 'monthly' FROM orders""")
def representation_dates(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"))
    return align.representation_dates(o, True).withColumn("kind", F.lit("dated")).unionByName(align.representation_dates(o, False).withColumn("kind", F.lit("monthly")))


@query(sql("dated", "SELECT series, ts, round(value, 4) + 0 AS value, dekad FROM dated"))
def asof_dekad(spark: S, sf: str) -> DataFrame:
    return align.asof_dekad(obs(spark, sf), spine(spark, sf)).where("dekad is not null").withColumn("value", r4("value"))


@query("""WITH c AS (SELECT max(o_orderdate)::DATE AS date FROM orders GROUP BY date_trunc('month', o_orderdate)),
    o AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 2) * INTERVAL 1 HOUR AS ts FROM orders),
    s AS (SELECT o_orderkey, c.date AS before FROM o ASOF LEFT JOIN c ON ts > c.date), u AS (SELECT o_orderkey, c.date AS upto FROM o ASOF LEFT JOIN c ON ts >= c.date)
    SELECT o_orderkey, before, upto FROM s JOIN u USING (o_orderkey)""")
def asof_calendar(spark: S, sf: str) -> DataFrame:
    """A calendar of the last order of each month; every other order comes an hour after midnight."""
    o = table(spark, sf, "orders")
    calendar = o.groupBy(F.trunc("o_orderdate", "month")).agg(F.to_date(F.max("o_orderdate")).alias("date"))
    rows = o.select("o_orderkey", F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 2 as int))").alias("ts"))
    both = align.asof_calendar(align.asof_calendar(rows, calendar, name="before"), calendar, strict=False, name="upto")
    return both.select("o_orderkey", "before", "upto")


@query(sql("obs", "SELECT series, ts::DATE AS date, round(avg(value), 4) + 0 AS value FROM obs GROUP BY ALL"))
def daily_mean(spark: S, sf: str) -> DataFrame:
    return align.daily_mean(obs(spark, sf)).withColumn("value", r4("value"))


@query(sql("means", "SELECT series, date, round(value, 4) + 0 AS value FROM means"))
def dekad_mean(spark: S, sf: str) -> DataFrame:
    return means(spark, sf).withColumn("value", r4("value"))


@query(sql("aligned", "SELECT series, date, round(value, 4) + 0 AS value FROM aligned"))
def align_to_spine(spark: S, sf: str) -> DataFrame:
    return aligned(spark, sf).withColumn("value", r4("value"))


@query(sql("interp", "SELECT series, date, round(value, 4) + 0 AS value FROM interp"))
def interpolate_linear(spark: S, sf: str) -> DataFrame:
    return fill.interpolate_linear(aligned(spark, sf)).withColumn("value", r4("value"))


@query(sql("num", """SELECT series, min(date) AS start_date, max(date) AS end_date, count(*)::INT AS length,
    CASE WHEN p = 0 THEN 'leading' WHEN p = n THEN 'trailing' ELSE 'inside' END AS kind FROM (SELECT *, count(value) OVER (PARTITION BY series ORDER BY date) AS p, count(value) OVER (PARTITION BY series) AS n FROM num) WHERE value IS NULL GROUP BY series, p, n"""))
def missing_runs(spark: S, sf: str) -> DataFrame:
    return fill.missing_runs(aligned(spark, sf))


@query(sql("fit", "SELECT series, round(slope, 3) + 0 AS slope, round(intercept, 3) + 0 AS intercept FROM fit"))
def trend_fit(spark: S, sf: str) -> DataFrame:
    return fill.trend_fit(fill.interpolate_linear(aligned(spark, sf))).select("series", (F.round("slope", 3) + 0.0).alias("slope"), (F.round("intercept", 3) + 0.0).alias("intercept"))


@query(sql("filled", "SELECT series, date, round(value, 3) + 0 AS value FROM filled"))
def trend_extrapolate(spark: S, sf: str) -> DataFrame:
    return filled(spark, sf).withColumn("value", F.round("value", 3) + 0.0)


@query(sql("filled", "SELECT series, date, round(value - lag(value) OVER (PARTITION BY series ORDER BY date), 3) + 0 AS delta FROM filled"))
def delta(spark: S, sf: str) -> DataFrame:
    return features.delta(filled(spark, sf)).select("series", "date", (F.round("delta", 3) + 0.0).alias("delta"))


@query(sql("aligned", "SELECT series, date, round(min(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW), 4) + 0 AS rolling_min FROM aligned"))
def rolling_min(spark: S, sf: str) -> DataFrame:
    return features.rolling_min(aligned(spark, sf)).select("series", "date", r4("rolling_min").alias("rolling_min"))


@query(sql("aligned", """SELECT series, date, CASE WHEN value IS NOT NULL THEN round(sum((value - m) / s) OVER (PARTITION BY series ORDER BY date), 4) + 0 END AS cumulative
    FROM (SELECT *, avg(value) OVER (PARTITION BY series) AS m, stddev_samp(value) OVER (PARTITION BY series) AS s FROM aligned)"""))
def cumulative_anomaly(spark: S, sf: str) -> DataFrame:
    return scale.cumulative_anomaly(aligned(spark, sf)).select("series", "date", r4("cumulative").alias("cumulative"))


@query(sql("aligned", """SELECT series, date, n AS slice FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM aligned), (VALUES (0), (180), (36)) v(n) WHERE n = 0 OR r <= n"""))
def recent_slices(spark: S, sf: str) -> DataFrame:
    return features.recent_slices(aligned(spark, sf)).select("series", "date", "slice")


@query(sql("aligned", "SELECT series, date, round(value, 4) + 0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM aligned) WHERE r <= 36"))
def last_n(spark: S, sf: str) -> DataFrame:
    return features.last_n(aligned(spark, sf), ["series"], n=36).withColumn("value", r4("value"))


@query(sql("aligned", "SELECT series, date, year(date)::INT AS year, dayofyear(date)::INT AS doy, (dense_rank() OVER (ORDER BY year(date)) - 1)::INT AS year_index, false AS predicted FROM aligned"))
def year_overlay(spark: S, sf: str) -> DataFrame:
    return features.year_overlay(aligned(spark, sf)).select("series", "date", "year", "doy", "year_index", "predicted")


@query("SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders")
def distinct_years(spark: S, sf: str) -> DataFrame:
    return features.distinct_years(table(spark, sf, "orders"), "o_orderdate")


@query(sql("aligned", "SELECT series, date, round(value, 4) + 0 AS value FROM aligned ORDER BY date, series"))
def sort_by_date(spark: S, sf: str) -> DataFrame:
    return align.sort_by_date(aligned(spark, sf).withColumn("value", r4("value")), keys=["series"])


SCALER = "sc AS (SELECT series, avg(value) AS mean, stddev_pop(value) AS std FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS r FROM filled) WHERE r <= 100 GROUP BY series)"


def scaler(spark: S, sf: str) -> DataFrame:
    return scale.fit_scaler(filled(spark, sf), first_n=100)


@query(sql("filled", "SELECT series, round(mean, 3) + 0 AS mean, round(std, 3) + 0 AS std FROM sc", SCALER))
def fit_scaler(spark: S, sf: str) -> DataFrame:
    return scaler(spark, sf).select("series", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query(sql("filled", "SELECT series, round(mean, 3) + 0 AS mean, round(std, 3) + 0 AS std FROM sc", SCALER.replace("r <= 100", "r <= 804")))
def fit_scaler_804(spark: S, sf: str) -> DataFrame:
    """The operator's own number of rows, which the series do not reach."""
    return scale.fit_scaler(filled(spark, sf)).select("series", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query(sql("filled", "SELECT series, date, round((value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 4) + 0 AS value FROM filled JOIN sc USING (series)", SCALER))
def zscore(spark: S, sf: str) -> DataFrame:
    return scale.zscore(filled(spark, sf), scaler(spark, sf)).select("series", "date", r4("value").alias("value"))


@query(sql("filled", "SELECT series, date, round(value, 3) + 0 AS value FROM filled"))
def unscale(spark: S, sf: str) -> DataFrame:
    stats = scaler(spark, sf)
    return scale.unscale(scale.zscore(filled(spark, sf), stats), stats).select("series", "date", (F.round("value", 3) + 0.0).alias("value"))


@query(sql("filled", "SELECT series, date, round(mean, 3) + 0 AS mean, round(std, 3) + 0 AS std FROM filled JOIN sc USING (series)", SCALER))
def stats_lookup(spark: S, sf: str) -> DataFrame:
    return scale.stats_lookup(filled(spark, sf), scaler(spark, sf), ["series"]).select("series", "date", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


SEASON = "st AS (SELECT series, strftime(date, '%m-%d') AS month_day, avg(value) AS mean, stddev_samp(value) AS std FROM filled GROUP BY ALL)"


def season(spark: S, sf: str) -> DataFrame:
    return scale.seasonal_stats(filled(spark, sf))


@query(sql("filled", "SELECT series, month_day, round(mean, 3) + 0 AS mean, round(std, 3) + 0 AS std FROM st", SEASON))
def seasonal_stats(spark: S, sf: str) -> DataFrame:
    return season(spark, sf).select("series", "month_day", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query(sql("filled", "SELECT f.series, f.date, strftime(f.date, '%m-%d') AS month_day, round(mean, 3) + 0 AS mean, round(std, 3) + 0 AS std FROM filled f LEFT JOIN st ON f.series = st.series AND strftime(f.date, '%m-%d') = month_day", SEASON))
def seasonal_lookup(spark: S, sf: str) -> DataFrame:
    return scale.seasonal_lookup(filled(spark, sf), season(spark, sf)).select("series", "date", "month_day", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query(sql("filled", """SELECT f.series, f.date, round(CASE WHEN mean IS NULL AND std IS NULL THEN value WHEN std = 0 THEN 0 ELSE (value - mean) / std END, 3) + 0 AS value
    FROM filled f LEFT JOIN st ON f.series = st.series AND strftime(f.date, '%m-%d') = month_day WHERE CASE WHEN mean IS NULL AND std IS NULL THEN value WHEN std = 0 THEN 0 ELSE (value - mean) / std END IS NOT NULL""", SEASON))
def seasonal_zscore(spark: S, sf: str) -> DataFrame:
    return scale.seasonal_zscore(filled(spark, sf), season(spark, sf)).select("series", "date", (F.round("value", 3) + 0.0).alias("value"))


# a lookup whose table lacks keys: the statistics of eleven months
ELEVEN = SEASON.replace("FROM filled", "FROM filled WHERE month(date) <> 2")


@query(sql("filled", """SELECT f.series, f.date, round(CASE WHEN mean IS NULL AND std IS NULL THEN value WHEN std = 0 THEN 0 ELSE (value - mean) / std END, 3) + 0 AS value
    FROM filled f LEFT JOIN st ON f.series = st.series AND strftime(f.date, '%m-%d') = month_day WHERE CASE WHEN mean IS NULL AND std IS NULL THEN value WHEN std = 0 THEN 0 ELSE (value - mean) / std END IS NOT NULL""", ELEVEN))
def seasonal_zscore_missing_keys(spark: S, sf: str) -> DataFrame:
    some = season(spark, sf).where("month_day not like '02-%'")
    return scale.seasonal_zscore(filled(spark, sf), some).select("series", "date", (F.round("value", 3) + 0.0).alias("value"))


FLAGS = ["A", "N", "R"]


def flag_series(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series"), cal.dekad_start("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("value"))


FLAG_SQL = f"fs AS (SELECT l_returnflag AS series, {dk('l_shipdate')} AS date, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"


@query(f"WITH {FLAG_SQL} SELECT date, " + ", ".join(f"round(max(CASE WHEN series = '{f}' THEN value END), 4) + 0 AS {f}" for f in FLAGS) + " FROM fs GROUP BY date")
def assemble_features(spark: S, sf: str) -> DataFrame:
    frames = {f: flag_series(spark, sf).where(F.col("series") == f) for f in FLAGS}
    return align.assemble_features(frames).select("date", *[r4(f).alias(f) for f in FLAGS])


def monthly(spark: S, sf: str, status: str, name: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return rows.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(r4(F.avg(F.col("o_totalprice") * PRICE)).alias(name))


MONTHLY = "{1} AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(avg(o_totalprice * 0.01414213562::DOUBLE), 4) + 0 AS {1} FROM orders WHERE o_orderstatus = '{0}' GROUP BY ALL)"


#: Orders by status, as three sources.
STATUSES = {"open": "O", "done": "F", "pending": "P"}
MONTHLIES = ", ".join(MONTHLY.format(status, name) for name, status in STATUSES.items())


@query(f"""WITH {MONTHLIES} SELECT make_date(year, month, 25) AS date_represented, (make_date(year, month, 25) + INTERVAL 1 MONTH)::DATE AS date_reported, open, done, pending
    FROM open FULL JOIN done USING (year, month) FULL JOIN pending USING (year, month)""")
def merge_indices(spark: S, sf: str) -> DataFrame:
    return align.merge_indices({n: align.representation_dates(monthly(spark, sf, s, n), False) for n, s in STATUSES.items()})


@query(f"WITH {MONTHLIES} SELECT year, month, open, done, pending FROM open JOIN done USING (year, month) JOIN pending USING (year, month)")
def join_sections(spark: S, sf: str) -> DataFrame:
    first, second, third = (monthly(spark, sf, s, n) for n, s in STATUSES.items())
    return align.join_sections(align.join_sections(first, second), third)


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(avg(o_totalprice * 0.01414213562::DOUBLE), 4) + 0 AS price FROM orders GROUP BY ALL")
def unpivot_months(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").alias("YEAR"), F.upper(F.date_format("o_orderdate", "MMM")).alias("m"), "o_totalprice")
    wide = rows.groupBy("YEAR").pivot("m", cal.MONTH_NAMES).agg(r4(F.avg(F.col("o_totalprice") * PRICE)))
    return align.unpivot_months(wide, "price").where("price is not null")


@query(sql("filled", """SELECT series, date, list_sum(w)::BIGINT AS total, len(w)::INT AS n, array_to_string([x::BIGINT for x in w], ',') AS steps, t1, t2, t3, t4, t5, t6 FROM (SELECT series, date, list(round(value)) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS w,
    """ + ", ".join(f"round(lead(value, {h}) OVER (PARTITION BY series ORDER BY date), 2) AS t{h}" for h in range(1, 7)) + " FROM filled) WHERE len(w) = 36"))
def supervised_windows(spark: S, sf: str) -> DataFrame:
    """All six horizons, and the window's values in their order."""
    out = features.supervised_windows(filled(spark, sf).withColumn("v", F.round("value")), ["v"], 36, 6, target="value")
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).cast("bigint")
    steps = F.concat_ws(",", F.transform("window", lambda x: x[0].cast("bigint").cast("string")))
    return out.select("series", "date", total.alias("total"), F.size("window").alias("n"), steps.alias("steps"), *[F.round(F.col("targets")[h], 2).alias(f"t{h + 1}") for h in range(6)])


@query("SELECT o_orderkey AS id, o_custkey AS px_custkey, o_orderdate::DATE AS px_date FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders)")
def select_rename(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate")).withColumnRenamed("o_custkey", "custkey")
    return align.select_rename(o, {"o_orderkey": "id", "custkey": "custkey", "date": "date"}, prefix="px_")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (1, 50) THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem")
def sentinel_to_null(spark: S, sf: str) -> DataFrame:
    return align.sentinel_to_null(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], [1.0, 50.0])


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN '*****' ELSE (o_orderkey % 1000)::VARCHAR END AS DOUBLE) AS v FROM orders")
def coerce_numeric(spark: S, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "*****").otherwise((F.col("o_orderkey") % 1000).cast("string"))
    return align.coerce_numeric(table(spark, sf, "orders").select("o_orderkey", text.alias("v")), ["v"])


@query("SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate >= DATE '1998-07-01'")
def study_period(spark: S, sf: str) -> DataFrame:
    return align.study_period(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), start="1998-07-01")


@query("SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE <= DATE '1997-03-15'")
def past_only(spark: S, sf: str) -> DataFrame:
    return align.past_only(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), F.lit("1997-03-15").cast("date"))


@query(sql("aligned", "SELECT series, date, round(value, 4) + 0 AS value FROM aligned WHERE value IS NOT NULL"))
def drop_incomplete_rows(spark: S, sf: str) -> DataFrame:
    return align.drop_incomplete_rows(aligned(spark, sf)).withColumn("value", r4("value"))


OPEN_DATES = "(SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'F')"


def done_dates(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("date"))


@query(f"SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE NOT IN {OPEN_DATES}")
def new_dates_only(spark: S, sf: str) -> DataFrame:
    return align.new_dates_only(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), done_dates(spark, sf)).select("o_orderkey", "date")


@query(f"SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE NOT IN {OPEN_DATES}")
def except_dates(spark: S, sf: str) -> DataFrame:
    return align.except_dates(dates(spark, sf), done_dates(spark, sf))


@query("SELECT o_orderkey, o_orderdate::DATE AS date, CASE WHEN o_orderdate >= DATE '1999-01-01' THEN o_totalprice END AS level FROM orders")
def union_history(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("level"))
    return align.union_history(o.where("date < '1999-01-01'").drop("level"), o.where("date >= '1999-01-01'")).select("o_orderkey", "date", "level")


@query(f"""SELECT 'orders' AS side, o_orderdate::DATE AS date, count(*) AS n FROM orders WHERE o_orderdate::DATE IN (SELECT l_shipdate::DATE FROM lineitem) GROUP BY ALL
    UNION ALL SELECT 'lineitem', l_shipdate::DATE, count(*) FROM lineitem WHERE l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders) GROUP BY ALL""")
def align_lengths(spark: S, sf: str) -> DataFrame:
    a, b = align.align_lengths(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")), table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")))
    count = lambda df, n: df.groupBy("date").agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "date", "n")
    return count(a, "orders").union(count(b, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 4) + 0 AS v FROM lineitem")
def round4(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (scalar.round4(F.col("l_extendedprice") / 7) + 0.0).alias("v"))


@query("SELECT c_custkey, greatest(c_acctbal, 0) + 0 AS v FROM customer")
def clip_zero(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", (scalar.clip_zero(F.col("c_acctbal")) + 0.0).alias("v"))
