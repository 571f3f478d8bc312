"""How the driver's tables play observations, cubes, grids and ensembles; in Spark and, as named SQL, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import align, fill

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, under its function's name, with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r4(c: Column | str) -> Column:
    """Rounded to 4 places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of 25 nations as irregular observations."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    named = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("series"))
    return orders.join(named, orders.o_custkey == named.c_custkey).select("series", F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") * PRICE).alias("value"))


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return cal.spine_of(cal.bounds_of(table(spark, sf, "orders"), "o_orderdate"))


def means(spark: SparkSession, sf: str) -> DataFrame:
    return align.dekad_mean(align.asof_dekad(obs(spark, sf), spine(spark, sf)))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_to_spine(means(spark, sf), spine(spark, sf))


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill.trend_extrapolate(fill.interpolate_linear(aligned(spark, sf)))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    """Daily cube of mean quantities on a 16 x 16 grid."""
    rows = table(spark, sf, "lineitem").select(F.lit("quantity").alias("variable"), F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"), "l_quantity")
    return rows.groupBy("variable", "date", "y", "x").agg(F.avg("l_quantity").alias("value"))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 grids, one date each."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("label"), F.col("vec_id"), F.posexplode("embedding").alias("p", "v"))
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int"))
    return rows.select(F.lit("grid").alias("variable"), date.alias("date"), "label", "vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("value"))


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same grids, an array a row."""
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int"))
    return table(spark, sf, "embeddings").select(
        F.lit("grid").alias("variable"), date.alias("date"), F.col("label").cast("int").alias("label"), "vec_id", F.col("embedding").cast("array<double>").alias("data")
    )


def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers of an embedding as samples of six horizons; its label as run. Of 64 numbers the last four begin an eleventh
    sample, whose last two horizons are null."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("run_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("p"))
    sample = (F.col("vec_id") * 11 + F.floor(F.col("p") / 6)).alias("sample")
    return rows.select("run_id", sample, (F.col("p") % 6).cast("int").alias("horizon"), F.get("embedding", F.col("p")).cast("double").alias("value"))


#: Prices have two decimals, so their means lie on ties of any rounding; times this factor they don't.
PRICE = 0.01414213562

SRC = {"x0": 0.0, "y0": 8.0, "dx": 1.0, "dy": -1.0, "height": 8, "width": 8}
DST = {"x0": 0.0, "y0": 8.0, "dx": 0.5, "dy": -0.5, "height": 16, "width": 16}
META16 = {"x0": 20.0, "y0": 10.0, "dx": 0.5, "dy": -0.5, "height": 16, "width": 16}
BOX = {"west": 21.0, "east": 25.0, "south": 3.0, "north": 8.0}

DK = "(date_trunc('month', {0})::DATE + (least((day({0}) - 1) // 10, 2) * 10)::INTEGER)"


def dk(e: str) -> str:
    """SQL of a date's dekad."""
    return DK.format(f"({e})::DATE")


_OBS = "obs AS (SELECT n_name AS series, o_orderdate AS ts, o_totalprice * 0.01414213562::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_SPINE = "days AS (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM orders), spine AS (SELECT date FROM days WHERE day(date) IN (1, 11, 21))"
_ASOF = "dated AS (SELECT series, ts, value, s.date AS dekad FROM obs ASOF JOIN spine s ON obs.ts > s.date)"
_MEANS = "means AS (SELECT series, dekad AS date, avg(value) AS value FROM dated GROUP BY ALL)"
_ALIGNED = "aligned AS (SELECT a.series, a.date, m.value FROM (SELECT series, date FROM (SELECT DISTINCT series FROM means), spine) a LEFT JOIN means m USING (series, date))"
_NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM aligned)"
_EDGE = """edge AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS va, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia,
        first_value(value IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib FROM num
        WINDOW a AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_INTERP = "interp AS (SELECT series, date, coalesce(value, va + (vb - va) / nullif(ib - ia, 0) * (i - ia)) AS value FROM edge)"
_FIT = """fit AS (SELECT series, regr_slope(value, 6 - r) AS slope, regr_intercept(value, 6 - r) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM interp WHERE value IS NOT NULL) WHERE r <= 6 GROUP BY series HAVING count(*) = 6)"""
_FILLED = """filled AS (SELECT series, date, coalesce(value, intercept + slope * (5 + k)) AS value FROM (SELECT *, sum((value IS NULL)::INT) OVER (PARTITION BY series ORDER BY date) AS k FROM interp) LEFT JOIN fit USING (series))"""
_CUBE = "cube AS (SELECT 'quantity' AS variable, l_shipdate::DATE AS date, (l_suppkey % 16)::INT AS y, (l_partkey % 16)::INT AS x, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_GRIDS = "grids AS (SELECT 'grid' AS variable, DATE '2020-01-01' + vec_id::INT AS date, label::INT AS label, vec_id, (p // 8)::INT AS y, (p % 8)::INT AS x, embedding[p + 1]::DOUBLE AS value FROM (SELECT *, unnest(range(0, len(embedding))) AS p FROM embeddings))"
_ENS = "ens AS (SELECT label::INT AS run_id, vec_id * 11 + p // 6 AS sample, (p % 6)::INT AS horizon, embedding[p + 1]::DOUBLE AS value FROM embeddings, range(0, 66) t(p))"

PARTS = {"obs": _OBS, "spine": _SPINE, "dated": _ASOF, "means": _MEANS, "aligned": _ALIGNED, "num": _NUM, "edge": _EDGE, "interp": _INTERP, "fit": _FIT, "filled": _FILLED, "cube": _CUBE, "grids": _GRIDS, "ens": _ENS}
SERIES = ["obs", "spine", "dated", "means", "aligned", "num", "edge", "interp", "fit", "filled"]


def sql(upto: str, body: str, *more: str) -> str:
    """SQL with the named tables that ``upto`` needs, more of them, and the body."""
    names = SERIES[: SERIES.index(upto) + 1] if upto in SERIES else [upto] if upto else []
    parts = [PARTS[n] for n in names] + [PARTS.get(m, m) for m in more]
    return ("WITH " + ",\n    ".join(parts) + "\n" if parts else "") + body
