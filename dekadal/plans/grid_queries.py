"""Queries on forecasts, cubes, regions and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import features, forecast, grid, patches, region, scale, tiles
from .bindings import BOX, DST, META16, SRC, cube, dk, ensemble, filled, grid_rows, grids, query, r4, sql, table

S = SparkSession


def r3(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 3) + F.lit(0.0)


# ---- forecasts

LAST6 = "d6 AS (SELECT series AS run_id, (6 - r)::INT AS horizon, date, d AS delta, abs(d) / 10 AS std FROM (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS d, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM filled) WHERE r <= 6)"
PRIOR = "pr AS (SELECT series AS run_id, value AS prior FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM filled) WHERE r = 7)"
LEVELS = """lv AS (SELECT run_id, horizon, date, greatest(prior + sum(delta) OVER w, 0) AS level, greatest(prior + sum(delta - 1.959963984540054 * std) OVER w, 0) AS lower, greatest(prior + sum(delta + 1.959963984540054 * std) OVER w, 0) AS upper
    FROM d6 JOIN pr USING (run_id) WINDOW w AS (PARTITION BY run_id ORDER BY horizon))"""
HISTORY = "hi AS (SELECT series AS run_id, date, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM filled) WHERE r > 6)"


def numbered(spark: S, sf: str) -> DataFrame:
    """Filled series with their differences, and rows numbered from the last one: one plan that all three parts share."""
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("date")))
    return features.delta(filled(spark, sf)).withColumn("r", back).withColumnRenamed("series", "run_id")


def deltas(spark: S, sf: str) -> DataFrame:
    rows = numbered(spark, sf).where("r <= 6")
    return rows.select("run_id", (6 - F.col("r")).cast("int").alias("horizon"), "date", "delta", (F.abs("delta") / 10).alias("std"))


def history(spark: S, sf: str) -> DataFrame:
    return numbered(spark, sf).where("r > 6").select("run_id", "date", "value")


def prior(spark: S, sf: str) -> DataFrame:
    return numbered(spark, sf).where("r = 7").select("run_id", F.col("value").alias("prior"))


def levels(spark: S, sf: str) -> DataFrame:
    rows = forecast.z_interval(deltas(spark, sf), "delta").join(prior(spark, sf), "run_id")
    return forecast.forecast_accumulate(rows).select("run_id", "horizon", "date", F.col("delta").alias("level"), "lower", "upper")


@query(sql("filled", "SELECT run_id, horizon, date, round(delta - 1.959963984540054 * std, 3) + 0 AS lower, round(delta + 1.959963984540054 * std, 3) + 0 AS upper FROM d6", LAST6))
def z_interval(spark: S, sf: str) -> DataFrame:
    return forecast.z_interval(deltas(spark, sf), "delta").select("run_id", "horizon", "date", r3("lower").alias("lower"), r3("upper").alias("upper"))


@query(sql("filled", "SELECT run_id, horizon, date, round(level, 2) + 0 AS level, round(lower, 2) + 0 AS lower, round(upper, 2) + 0 AS upper FROM lv", LAST6, PRIOR, LEVELS))
def forecast_accumulate(spark: S, sf: str) -> DataFrame:
    return levels(spark, sf).withColumns({c: F.round(c, 2) + 0.0 for c in ("level", "lower", "upper")})


@query(sql("filled", """, st AS (SELECT series AS run_id, strftime(date, '%m-%d') AS md, avg(value) AS m, stddev_samp(value) AS s FROM filled GROUP BY ALL),
    sd AS (SELECT run_id, horizon, date, delta / 1e3 AS z, std / 1e3 AS e, m, s, prior FROM d6 JOIN pr USING (run_id) JOIN st USING (run_id) WHERE strftime(date, '%m-%d') = md)
    SELECT run_id, horizon, date, round(greatest(prior + sum(z * s + m) OVER w, 0), 1) + 0 AS level, round(greatest(prior + sum((z - 1.959963984540054 * e) * s + m) OVER w, 0), 1) + 0 AS lower_bound_95,
    round(greatest(prior + sum((z + 1.959963984540054 * e) * s + m) OVER w, 0), 1) + 0 AS upper_bound_95 FROM sd WINDOW w AS (PARTITION BY run_id ORDER BY horizon)""", LAST6, PRIOR).replace("\n, st AS", ",\n st AS"))
def rescale_forecast(spark: S, sf: str) -> DataFrame:
    stats = scale.seasonal_stats(filled(spark, sf)).withColumnRenamed("series", "run_id")
    scaled = deltas(spark, sf).withColumn("delta", F.col("delta") / 1e3).withColumn("std", F.col("std") / 1e3)
    out = forecast.rescale_forecast(scaled, stats, prior(spark, sf))
    return out.withColumns({c: F.round(c, 1) + 0.0 for c in ("level", "lower_bound_95", "upper_bound_95")})


@query(sql("filled", "SELECT run_id, round(max(level), 2) + 0 AS peak, arg_max(date, level)::DATE AS peak_date FROM (SELECT * FROM lv ORDER BY date) GROUP BY run_id", LAST6, PRIOR, LEVELS).replace("arg_max(date, level)::DATE", "min(date) FILTER (level = top)").replace("FROM (SELECT * FROM lv ORDER BY date)", "FROM (SELECT *, max(level) OVER (PARTITION BY run_id) AS top FROM lv)"))
def peak_forecast(spark: S, sf: str) -> DataFrame:
    return forecast.peak_forecast(levels(spark, sf)).select("run_id", (F.round("peak", 2) + 0.0).alias("peak"), "peak_date")


ALERT = """, pk AS (SELECT run_id, max(level) AS peak FROM lv GROUP BY run_id), pd AS (SELECT run_id, peak, min(date) AS peak_date FROM lv JOIN pk USING (run_id) WHERE level = peak GROUP BY ALL),
    lo AS (SELECT run_id, min(value) AS season_min, max(date) AS last_date FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date DESC) AS r FROM hi) WHERE r <= 18 GROUP BY run_id),
    al AS (SELECT *, peak - season_min AS rise FROM pd JOIN lo USING (run_id))"""


@query(sql("filled", ALERT + " SELECT run_id, round(peak, 2) + 0 AS peak, peak_date, round(season_min, 2) + 0 AS season_min, round(rise, 2) + 0 AS rise, rise > 700 AS alert FROM al", LAST6, PRIOR, LEVELS, HISTORY).replace("\n, pk AS", ",\n pk AS"))
def flood_alert(spark: S, sf: str) -> DataFrame:
    out = forecast.flood_alert(history(spark, sf), levels(spark, sf), threshold=700)
    return out.select("run_id", (F.round("peak", 2) + 0.0).alias("peak"), "peak_date", (F.round("season_min", 2) + 0.0).alias("season_min"), (F.round("rise", 2) + 0.0).alias("rise"), "alert")


PCT = "format('{{:.1f}}', round_even({0} * 100, 1))"


ALERT_TEXT = "SELECT c_custkey, 'Alert of 2024-05-01: extent expected to reach ' || " + PCT.format("(c_custkey / 16384)") + " || '% by 2024-06-11, a rise of ' || " + PCT.format("(c_custkey / 32768)") + " || '% above the season''s minimum of ' || " + PCT.format("(c_custkey / 65536)") + " || '%.' AS message FROM customer"


@query(ALERT_TEXT)
def alert_message(spark: S, sf: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", scalar.alert_message(day("2024-05-01"), k / 16384, day("2024-06-11"), k / 32768, k / 65536).alias("message"))


@query(sql("ens", "SELECT run_id, horizon, round(avg(value), 4) + 0 AS mean, round(stddev_pop(value), 4) + 0 AS std FROM ens GROUP BY ALL"))
def ensemble_summary(spark: S, sf: str) -> DataFrame:
    return forecast.ensemble_summary(ensemble(spark, sf)).select("run_id", "horizon", r4("mean").alias("mean"), r4("std").alias("std"))


PAIRS = "pairs AS (SELECT sample AS run_id, horizon, value AS truth, lead(value) OVER (PARTITION BY sample ORDER BY horizon) AS predicted FROM ens)"


def pairs(spark: S, sf: str) -> DataFrame:
    rows = ensemble(spark, sf)
    nxt = F.lead("value").over(Window.partitionBy("sample").orderBy("horizon"))
    return rows.select(F.col("sample").alias("run_id"), "horizon", F.col("value").alias("truth"), nxt.alias("predicted")).where("truth is not null and predicted is not null")


@query(sql("ens", """SELECT round(mse, 6) AS mse, round(p, 6) AS sign_penalty, round(d2, 6) AS sum_penalty, round(mse * p + 0.1 * d2, 5) AS loss FROM (
    SELECT (SELECT avg((truth - predicted) ** 2) FROM pairs WHERE predicted IS NOT NULL) AS mse, (SELECT avg(CASE WHEN sign(truth) <> sign(predicted) THEN 20 ELSE 1 END) FROM pairs WHERE predicted IS NOT NULL) AS p,
    (SELECT avg(d * d) FROM (SELECT sum(truth - predicted) AS d FROM pairs WHERE predicted IS NOT NULL GROUP BY run_id)) AS d2)""", PAIRS))
def forecast_loss(spark: S, sf: str) -> DataFrame:
    out = forecast.forecast_loss(pairs(spark, sf))
    return out.select(F.round("mse", 6).alias("mse"), F.round("sign_penalty", 6).alias("sign_penalty"), F.round("sum_penalty", 6).alias("sum_penalty"), F.round("loss", 5).alias("loss"))


@query(sql("ens", "SELECT horizon, round(avg((truth - predicted) ** 2), 6) AS mse, round(avg(abs(truth - predicted)), 6) AS mae FROM pairs WHERE predicted IS NOT NULL GROUP BY horizon", PAIRS))
def forecast_metrics(spark: S, sf: str) -> DataFrame:
    return forecast.forecast_metrics(pairs(spark, sf), ["horizon"]).select("horizon", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


@query("SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, max(o_orderdate) AS run_end FROM orders")
def latest_run(spark: S, sf: str) -> DataFrame:
    return forecast.latest_run(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_end")))


# ---- cubes

DAYS = f"dy AS (SELECT {dk('date')} AS dekad FROM (SELECT DISTINCT date FROM cube) GROUP BY 1 HAVING count(*) >= 8)"


@query(sql("cube", f"SELECT variable, dekad AS date, y, x, round(value, 4) + 0 AS value FROM (SELECT variable, {dk('date')} AS dekad, y, x, avg(value) AS value FROM cube GROUP BY ALL) JOIN dy USING (dekad)", DAYS))
def grid_dekad_mean(spark: S, sf: str) -> DataFrame:
    return grid.grid_dekad_mean(cube(spark, sf)).withColumn("value", r4("value"))


@query(sql("cube", "SELECT variable, date, round(sum(value), 3) + 0 AS total, round(sum(value) / count(*), 4) + 0 AS share FROM cube GROUP BY ALL"))
def grid_total(spark: S, sf: str) -> DataFrame:
    return grid.grid_total(cube(spark, sf)).select("variable", "date", r3("total").alias("total"), r4("share").alias("share"))


LL = "ll AS (SELECT *, 20 + (x + 0.5) * 0.5 AS lon, 10 - (y + 0.5) * 0.5 AS lat FROM cube)"
IN_BOX = "lon BETWEEN 21 AND 25 AND lat BETWEEN 3 AND 8"


@query(sql("cube", f"SELECT variable, date, round(avg(value), 4) + 0 AS value FROM ll WHERE {IN_BOX} GROUP BY ALL", LL))
def area_average(spark: S, sf: str) -> DataFrame:
    return grid.area_average(grid.cell_geometry(cube(spark, sf), META16), BOX).withColumn("value", r4("value"))


@query(sql("cube", f"SELECT variable, date, round_even(avg(value), 4) + 0 AS value FROM ll WHERE {IN_BOX} GROUP BY ALL", LL))
def extract_area(spark: S, sf: str) -> DataFrame:
    return grid.extract_area(cube(spark, sf), BOX, META16).withColumn("value", scalar.round4(F.col("value")) + 0.0)


@query(sql("cube", f"SELECT date, y, x, lon, lat, round(value, 4) + 0 AS value FROM ll WHERE {IN_BOX}", LL).replace("lon, lat,", "lon::DOUBLE AS lon, lat::DOUBLE AS lat,"))
def bbox_filter(spark: S, sf: str) -> DataFrame:
    return grid.bbox_filter(grid.cell_geometry(cube(spark, sf), META16), BOX).select("date", "y", "x", "lon", "lat", r4("value").alias("value"))


@query(sql("cube", f"SELECT date, y, x, round(value, 4) + 0 AS value FROM ll WHERE {IN_BOX}", LL))
def extract_domain(spark: S, sf: str) -> DataFrame:
    return grid.extract_domain(cube(spark, sf), BOX, META16).select("date", "y", "x", r4("value").alias("value"))


@query(sql("cube", "SELECT DISTINCT y, x, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM ll", LL))
def cell_geometry(spark: S, sf: str) -> DataFrame:
    return grid.cell_geometry(cube(spark, sf).select("y", "x").distinct(), META16)


PTS = "pts AS (SELECT c_custkey, c_name AS name, 18 + (c_custkey % 97) * 0.125 AS lon, 1 + (c_custkey % 89) * 0.125 AS lat FROM customer)"
CELLS = "nc AS (SELECT *, greatest(0, least(15, floor((lon - 20) / 0.5)))::INT AS x, greatest(0, least(15, floor((lat - 10) / -0.5)))::INT AS y FROM pts)"


def points(spark: S, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), (18 + (k % 97) * 0.125).alias("lon"), (1 + (k % 89) * 0.125).alias("lat"))


@query(f"WITH {PTS} SELECT c_custkey, lon BETWEEN 19 AND 26.5 AND lat BETWEEN 2 AND 9.25 AS in_domain FROM pts")
def validate_domain(spark: S, sf: str) -> DataFrame:
    return grid.validate_domain(points(spark, sf), {"west": 19.0, "east": 26.5, "south": 2.0, "north": 9.25}).select("c_custkey", "in_domain")


@query(f"WITH {PTS}, {CELLS} SELECT c_custkey, y, x FROM nc")
def nearest_cell(spark: S, sf: str) -> DataFrame:
    return grid.nearest_cell(points(spark, sf), META16).select("c_custkey", "y", "x")


@query(sql("cube", "SELECT c_custkey, date, round(value, 4) + 0 AS value FROM nc JOIN cube USING (y, x)", PTS, CELLS))
def extract_point(spark: S, sf: str) -> DataFrame:
    rounded = cube(spark, sf).select("y", "x", "date", r4("value").alias("value"))
    return grid.extract_point(rounded, points(spark, sf).drop("name"), META16).select("c_custkey", "date", "value")


@query(sql("cube", "SELECT variable, date, y, x, round(sum(value) OVER (PARTITION BY y, x ORDER BY date), 3) + 0 AS value FROM cube"))
def cumulative_cube(spark: S, sf: str) -> DataFrame:
    """In two runs: the second continues from the last slice of the first."""
    rows = cube(spark, sf)
    first, second = rows.where("date < '1998-01-01'"), rows.where("date >= '1998-01-01'")
    done = grid.cumulative_cube(first)
    newest = F.row_number().over(Window.partitionBy("variable", "y", "x").orderBy(F.desc("date")))
    last = done.withColumn("r", newest).where("r = 1").drop("r")
    return done.unionByName(grid.cumulative_cube(second, last)).withColumn("value", r3("value"))


@query("WITH n AS (SELECT l_returnflag AS variable, count(DISTINCT l_shipdate::DATE) AS n_dates FROM lineitem GROUP BY 1) SELECT *, (SELECT min(n_dates) = max(n_dates) FROM n) AS all_equal FROM n")
def series_length_check(spark: S, sf: str) -> DataFrame:
    return grid.series_length_check(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variable"), F.to_date("l_shipdate").alias("date")))


@query(sql("grids", "SELECT date, y, x, (value > 0)::INT AS value FROM grids"))
def binarise(spark: S, sf: str) -> DataFrame:
    return grid.binarise(grids(spark, sf)).select("date", "y", "x", "value")


@query(sql("grids", """SELECT date, y, x, channel, round(value, 4) + 0 AS value FROM (SELECT date, y, x, 'a' AS channel, value FROM grids UNION ALL SELECT date, y, x, 'b', -value FROM grids
    UNION ALL SELECT d.date, y, x, 'static', value FROM (SELECT y, x, avg(value) AS value FROM grids GROUP BY ALL), (SELECT DISTINCT date FROM grids) d)"""))
def stack_channels(spark: S, sf: str) -> DataFrame:
    g = grids(spark, sf)
    static = g.groupBy("y", "x").agg(F.avg("value").alias("value"))
    return grid.stack_channels({"a": g, "b": g.withColumn("value", -F.col("value"))}, {"static": static}).withColumn("value", r4("value"))


AX = """ax AS (SELECT t, (plc - k)::INT AS i, CASE WHEN k = 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM (SELECT t, (t + 0.5) * 0.5 - 0.5 AS pos, k, floor((t + 0.5) * 0.5 - 0.5) + 2 * k AS plc FROM range(0, 16) r(t), (VALUES (0), (1)) v(k)))"""


@query(sql("grids", """SELECT variable, date, a.t::INT AS y, b.t::INT AS x, round(sum(value * a.w * b.w) / sum(CASE WHEN value IS NOT NULL THEN a.w * b.w END), 4) + 0 AS value FROM grids g JOIN ax a ON g.y = a.i JOIN ax b ON g.x = b.i WHERE a.w * b.w > 0 GROUP BY ALL""", AX))
def regrid_bilinear(spark: S, sf: str) -> DataFrame:
    """In tiles of 4 x 4; cells are a view of the result."""
    rows = tiles.grid_tiles(grid_rows(spark, sf).select("variable", "date", "data"), 8, 8, 4)
    return tiles.tile_cells(tiles.tile_regrid(rows, SRC, DST, tile=4), 16, 16, 4).withColumn("value", r4("value"))


@query(sql("grids", "SELECT variable, date, t::INT AS y, u::INT AS x, round(value, 4) + 0 AS value FROM grids, range(0, 16) a(t), range(0, 16) b(u) WHERE t // 2 = y AND u // 2 = x"))
def regrid_nearest(spark: S, sf: str) -> DataFrame:
    return grid.regrid_nearest(grids(spark, sf), SRC, DST).withColumn("value", r4("value"))


# ---- regions: polygons by the nations' keys, so that they grow with the table

REGION_SQL = """rg AS (SELECT n_name AS region, 20.0137 + (n_nationkey % 5) * 1.3 AS a, 3.0071 + (n_nationkey // 5) * 1.1 AS b FROM nation),
    edges AS (SELECT region, a AS ux, b AS uy, a + 2.1 AS vx, b + 0.3 AS vy FROM rg UNION ALL SELECT region, a + 2.1, b + 0.3, a + 1.2, b + 1.9 FROM rg UNION ALL SELECT region, a + 1.2, b + 1.9, a, b FROM rg)"""
INSIDE = "(uy > {y}) <> (vy > {y}) AND {x} < (vx - ux) * ({y} - uy) / (vy - uy) + ux"


def regions(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("region"), (20.0137 + (F.col("n_nationkey") % 5) * 1.3).alias("a"), (3.0071 + F.floor(F.col("n_nationkey") / 5) * 1.1).alias("b"))
    p = lambda dx, dy: F.struct((F.col("a") + dx).alias("x"), (F.col("b") + dy).alias("y"))
    return n.select("region", F.lit(0).alias("ring_id"), F.lit(False).alias("is_hole"), F.array(p(0.0, 0.0), p(2.1, 0.3), p(1.2, 1.9)).alias("pts"))


def cells16(spark: S, sf: str) -> DataFrame:
    return cube(spark, sf).select("y", "x").distinct()


CELL_SQL = "cl AS (SELECT DISTINCT y, x, 20 + (x + 0.5) * 0.5 AS lon, 10 - (y + 0.5) * 0.5 AS lat FROM cube)"
RC = f"rc AS (SELECT region, y, x FROM cl, edges WHERE {INSIDE.format(x='lon', y='lat')} GROUP BY ALL HAVING count(*) % 2 = 1)"


@query(sql("cube", "SELECT region, y, x FROM rc", REGION_SQL, CELL_SQL, RC))
def rasterize_region(spark: S, sf: str) -> DataFrame:
    return region.rasterize_region(cells16(spark, sf), regions(spark, sf), META16, all_touched=False)


#: An edge meets a box if their boxes meet and the corners of the one are not all on one side of the line of the other.
SIDE = "((vx - ux) * ({y} - uy) - (vy - uy) * ({x} - ux))"
CORNERS = [SIDE.format(x=f"(lon {a} 0.25)", y=f"(lat {b} 0.25)") for a in "+-" for b in "+-"]
TOUCHED = f"least(ux, vx) <= lon + 0.25 AND greatest(ux, vx) >= lon - 0.25 AND least(uy, vy) <= lat + 0.25 AND greatest(uy, vy) >= lat - 0.25 AND least({', '.join(CORNERS)}) <= 0 AND greatest({', '.join(CORNERS)}) >= 0"
RT = f"rt AS (SELECT region, y, x FROM rc UNION SELECT region, y, x FROM cl, edges WHERE {TOUCHED})"


@query(sql("cube", "SELECT region, y, x FROM rt", REGION_SQL, CELL_SQL, RC, RT))
def rasterize_region_all_touched(spark: S, sf: str) -> DataFrame:
    """From a table that repeats its cells, a row for each date."""
    return region.rasterize_region(cube(spark, sf).select("y", "x"), regions(spark, sf), META16, all_touched=True)


@query(sql("cube", "SELECT variable, region, date, round(avg(value), 4) + 0 AS value FROM cube JOIN rt USING (y, x) GROUP BY ALL", REGION_SQL, CELL_SQL, RC, RT))
def zonal_mean_all_touched(spark: S, sf: str) -> DataFrame:
    return region.zonal_mean(cube(spark, sf), rasterize_region_all_touched(spark, sf)).withColumn("value", r4("value"))


def region_cells(spark: S, sf: str) -> DataFrame:
    return rasterize_region(spark, sf)


@query(sql("cube", "SELECT variable, region, date, round(avg(value), 4) + 0 AS value FROM cube JOIN rc USING (y, x) GROUP BY ALL", REGION_SQL, CELL_SQL, RC))
def zonal_mean(spark: S, sf: str) -> DataFrame:
    return region.zonal_mean(cube(spark, sf), region_cells(spark, sf)).withColumn("value", r4("value"))


@query(sql("cube", "SELECT region, date, y, x, round(value, 4) + 0 AS value FROM cube JOIN rc USING (y, x)", REGION_SQL, CELL_SQL, RC))
def mask_cube(spark: S, sf: str) -> DataFrame:
    return region.mask_cube(cube(spark, sf), region_cells(spark, sf)).select("region", "date", "y", "x", r4("value").alias("value"))


@query(sql("cube", """, own AS (SELECT DISTINCT y, x FROM rc WHERE region = 'NATION_07' OR region IN (SELECT n_name FROM nation WHERE n_nationkey = 7)), bx AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM own)
    SELECT variable, date, (c.y - y0)::INT AS y, (c.x - x0)::INT AS x, CASE WHEN o.y IS NOT NULL THEN round(value, 4) ELSE -1 END + 0 AS value FROM cube c CROSS JOIN bx LEFT JOIN own o ON o.y = c.y AND o.x = c.x WHERE c.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1""", REGION_SQL, CELL_SQL, RC).replace("\n, own AS", ",\n own AS"))
def clip_to_geometry(spark: S, sf: str) -> DataFrame:
    name = table(spark, sf, "nation").where("n_nationkey = 7").select(F.col("n_name").alias("region"))
    own = region_cells(spark, sf).join(F.broadcast(name), "region", "left_semi")
    return region.clip_to_geometry(cube(spark, sf).withColumn("value", r4("value")), own, fill=-1.0)


@query(f"WITH {PTS}, {REGION_SQL} SELECT c_custkey, region FROM pts, edges WHERE {INSIDE.format(x='lon', y='lat')} GROUP BY ALL HAVING count(*) % 2 = 1")
def spatial_join_points(spark: S, sf: str) -> DataFrame:
    return region.spatial_join_points(points(spark, sf), regions(spark, sf), "lon", "lat").select("c_custkey", "region")


@query(f"WITH {PTS}, {REGION_SQL} SELECT lon::DOUBLE AS lon, lat::DOUBLE AS lat, region FROM (SELECT c_custkey, lon, lat, region FROM pts, edges WHERE {INSIDE.format(x='lon', y='lat')} GROUP BY ALL HAVING count(*) % 2 = 1)")
def spatial_join_places(spark: S, sf: str) -> DataFrame:
    """The points without their keys, so that rows repeat."""
    return region.spatial_join_points(points(spark, sf).select("lon", "lat"), regions(spark, sf), "lon", "lat")


@query("SELECT n_name AS region, round(20.0137 + (n_nationkey % 5) * 1.3 - 0.42, 4)::DOUBLE AS xmin, round(22.1137 + (n_nationkey % 5) * 1.3 + 0.42, 4)::DOUBLE AS xmax, round(3.0071 + (n_nationkey // 5) * 1.1 - 0.38, 4)::DOUBLE AS ymin, round(4.9071 + (n_nationkey // 5) * 1.1 + 0.019, 4)::DOUBLE AS ymax FROM nation")
def region_bbox(spark: S, sf: str) -> DataFrame:
    return region.region_bbox(regions(spark, sf), (0.2, 0.2, 0.2, 0.01)).select("region", *[r4(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query("SELECT c_custkey, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def region_filter(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("region"))
    return region.region_filter(rows, n.agg(F.min("n_name")).first()[0])


@query("SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def union_regions(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.lit(0).alias("level"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return region.union_regions([n, r])


# ---- patches: the grids of each label are a stack of dates; patch 4, stride 2, tiles of 2 x 2


def labelled_patches(spark: S, sf: str, steps: int = 3) -> DataFrame:
    rows = grid_rows(spark, sf).select("label", "date", F.lit("g").alias("channel"), "data")
    return tiles.tile_patches(tiles.grid_tiles(rows, 8, 8, 2), 8, 8, size=4, stride=2, steps=steps, end_offset=1, keys=["label"], tile=2)


def labelled_pixels(spark: S, sf: str) -> DataFrame:
    """The cells of the patches, a view."""
    return tiles.square_cells(labelled_patches(spark, sf), 4)


LABEL_DATES = "ld AS (SELECT label, date, (4 - r)::INT AS step FROM (SELECT label, date, row_number() OVER (PARTITION BY label ORDER BY date DESC) AS r FROM (SELECT DISTINCT label, date FROM grids)) WHERE r BETWEEN 2 AND 4)"
LABEL_PIX = "px AS (SELECT label, p AS y0, q AS x0, step, (y - p)::INT AS y, (x - q)::INT AS x, value FROM grids JOIN ld USING (label, date), range(0, 5, 2) a(p), range(0, 5, 2) b(q) WHERE y BETWEEN p AND p + 3 AND x BETWEEN q AND q + 3)"


@query(sql("grids", "SELECT label, y0::INT AS y0, x0::INT AS x0, step, y, x, round(value, 4) + 0 AS value FROM px", LABEL_DATES, LABEL_PIX))
def patch_windows(spark: S, sf: str) -> DataFrame:
    return labelled_pixels(spark, sf).select("label", "y0", "x0", "step", "y", "x", r4("value").alias("value"))


@query(sql("grids", "SELECT label, y0::INT AS y0, x0::INT AS x0, step, y, x, round(value, 4) + 0 AS value FROM px WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2", LABEL_DATES, LABEL_PIX))
def crop_border(spark: S, sf: str) -> DataFrame:
    return patches.crop_border(labelled_pixels(spark, sf), 4, 1).select("label", "y0", "x0", "step", "y", "x", r4("value").alias("value"))


@query(sql("grids", """SELECT st.label, st.step, a.y::INT AS y, b.x::INT AS x, round(m.value, 4) + 0 AS value FROM (SELECT DISTINCT label, step FROM px) st, range(0, 8) a(y), range(0, 8) b(x)
    LEFT JOIN (SELECT label, step, y0 + y AS y, x0 + x AS x, avg(value) AS value FROM px WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2 GROUP BY ALL) m ON m.label = st.label AND m.step = st.step AND m.y = a.y AND m.x = b.x""", LABEL_DATES, LABEL_PIX))
def mosaic_mean(spark: S, sf: str) -> DataFrame:
    mosaic = tiles.tile_mosaic(labelled_patches(spark, sf), 8, 8, 4, border=1, keys=["label", "step"], tile=2)
    return tiles.tile_cells(mosaic, 8, 8, 2).withColumn("value", r4("value"))


@query(sql("grids", "SELECT vec_id, y, x, (rk <= n)::INT AS flooded FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY value DESC) AS rk, round_even(0.3 * count(*) OVER (PARTITION BY vec_id), 0) AS n FROM grids)"))
def rank_mask(spark: S, sf: str) -> DataFrame:
    return patches.rank_mask(grids(spark, sf), 0.3, ["vec_id"]).select("vec_id", "y", "x", "flooded")


MEAN_GRID = "mg AS (SELECT y, x, avg(value) AS value FROM grids GROUP BY ALL), cu AS (SELECT y, x, min_by(value, date) AS value FROM grids GROUP BY ALL)"
FC = "fc AS (SELECT * FROM (VALUES ('worst', 0.6), ('average', 0.4), ('best', 0.2)) v(scenario, pct))"
MASKS = "mk AS (SELECT scenario, y, x, (rk <= n)::INT AS flooded FROM (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY value DESC) AS rk, round_even(pct * count(*) OVER (PARTITION BY scenario), 0) AS n FROM mg, fc))"
CHANGE = """ch AS (SELECT y, x, current, worst, average, best, CASE current * 8 + worst * 4 + average * 2 + best WHEN 0 THEN 'no_change_dry' WHEN 15 THEN 'no_change_flooded' WHEN 8 THEN 'very_likely_decrease' WHEN 12 THEN 'likely_decrease'
    WHEN 14 THEN 'possible_decrease' WHEN 7 THEN 'very_likely_increase' WHEN 6 THEN 'likely_increase' WHEN 4 THEN 'possible_increase' ELSE 'unclassified' END AS change FROM (
    SELECT y, x, (c.value > 0)::INT AS current, max(CASE WHEN scenario = 'worst' THEN flooded END) AS worst, max(CASE WHEN scenario = 'average' THEN flooded END) AS average, max(CASE WHEN scenario = 'best' THEN flooded END) AS best FROM cu c JOIN mk USING (y, x) GROUP BY y, x, c.value))"""


def mask_rows(spark: S, sf: str) -> DataFrame:
    g = grids(spark, sf)
    mean = g.groupBy("y", "x").agg(F.avg("value").alias("value"))
    fc = g.agg(F.max("date").alias("date")).select("date", F.lit(0.6).alias("upper_bound_95"), F.lit(0.4).alias("level"), F.lit(0.2).alias("lower_bound_95"))
    return patches.scenario_masks(mean, fc)


def change_rows(spark: S, sf: str) -> DataFrame:
    current = grids(spark, sf).groupBy("y", "x").agg(F.min_by("value", "date").alias("value"))
    return patches.flood_change_map(current, mask_rows(spark, sf))


@query(sql("grids", "SELECT scenario, y, x, flooded FROM mk", MEAN_GRID, FC, MASKS))
def scenario_masks(spark: S, sf: str) -> DataFrame:
    return mask_rows(spark, sf)


@query(sql("grids", "SELECT y, x, current, worst, average, best, change FROM ch", MEAN_GRID, FC, MASKS, CHANGE))
def flood_change_map(spark: S, sf: str) -> DataFrame:
    return change_rows(spark, sf).select("y", "x", "current", "worst", "average", "best", "change")


@query(sql("grids", "SELECT half, change, count(*) AS n_cells FROM (SELECT *, CASE WHEN y < 4 THEN 'north' ELSE 'south' END AS half FROM ch) GROUP BY ROLLUP (half, change)", MEAN_GRID, FC, MASKS, CHANGE))
def change_area(spark: S, sf: str) -> DataFrame:
    half = F.when(F.col("y") < 4, "north").otherwise("south")
    return patches.change_area(change_rows(spark, sf).withColumn("half", half), ["half"])


@query("""SELECT vec_id, b1, b2, b3, b4, CASE b1 * 8 + b2 * 4 + b3 * 2 + b4 WHEN 0 THEN 'no_change_dry' WHEN 15 THEN 'no_change_flooded' WHEN 8 THEN 'very_likely_decrease' WHEN 12 THEN 'likely_decrease'
    WHEN 14 THEN 'possible_decrease' WHEN 7 THEN 'very_likely_increase' WHEN 6 THEN 'likely_increase' WHEN 4 THEN 'possible_increase' ELSE 'unclassified' END AS change
    FROM (SELECT vec_id, (embedding[1] > 0)::INT AS b1, (embedding[2] > 0)::INT AS b2, (embedding[3] > 0)::INT AS b3, (embedding[4] > 0)::INT AS b4 FROM embeddings)""")
def change_class(spark: S, sf: str) -> DataFrame:
    bits = [(F.col("embedding")[i] > 0).cast("int").alias(f"b{i + 1}") for i in range(4)]
    return table(spark, sf, "embeddings").select("vec_id", *bits).withColumn("change", scalar.change_class(*[F.col(f"b{i}") for i in range(1, 5)]))


@query(sql("grids", "SELECT round(avg(-(t * 0.95 + (1 - t) * 0.05) * (1 - h) ** 3 * ln(h)), 6) AS focal_loss FROM (SELECT t, t * q + (1 - t) * (1 - q) AS h FROM (SELECT (label < 5)::INT AS t, least(greatest(1 / (1 + exp(-value)), 1e-7), 1 - 1e-7) AS q FROM grids WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6))"))
def focal_loss(spark: S, sf: str) -> DataFrame:
    pixels = grids(spark, sf).select("y", "x", (F.col("label") < 5).cast("int").alias("truth"), (1 / (1 + F.exp(-F.col("value")))).alias("p"))
    return forecast.focal_loss(pixels, size=8, border=1).select(F.round("focal_loss", 6).alias("focal_loss"))
