"""Raster cubes in cell form: (variable, date, y, x, value). Cells partition by place and date, never by one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalar import binarise as positive

#: Longitudes and latitudes that the source grids cover.
DOMAIN = {"west": -19.0125, "east": 51.975, "south": -35.9625, "north": 38.025}


def grid_dekad_mean(cube: DataFrame, min_days: int = 8, keys: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Per cell: mean over the days of a dekad, for dekads with at least min_days days in the cube. The label is the
    dekad's first day. Days are counted per dekad from the distinct dates, not per cell, so null cells do not matter."""
    rows = cube.withColumn("dekad", cal.dekad_start("date"))
    days = rows.select(*keys, "dekad", "date").distinct().groupBy(*keys, "dekad").agg(F.count("*").alias("n")).where(F.col("n") >= min_days)
    means = rows.groupBy(*keys, "dekad", "y", "x").agg(F.avg("value").alias("value"))
    return means.join(days.drop("n"), [*keys, "dekad"], "left_semi").withColumnRenamed("dekad", "date")


def grid_total(cube: DataFrame, keys: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Sum over the cells per date, and that sum by the number of all cells."""
    return cube.groupBy(*keys, "date").agg(F.sum("value").alias("total"), (F.sum("value") / F.count("*")).alias("share"))


def area_average(cube: DataFrame, bbox: dict | None = None, keys: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Unweighted mean over a box per date; nulls are skipped."""
    return (bbox_filter(cube, bbox) if bbox else cube).groupBy(*keys, "date").agg(F.avg("value").alias("value"))


def bbox_filter(df: DataFrame, bbox: dict, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Inclusive, whichever way the axes run."""
    return df.where(F.col(lon).between(bbox["west"], bbox["east"]) & F.col(lat).between(bbox["south"], bbox["north"]))


def validate_domain(df: DataFrame, box: dict = DOMAIN, lon: str = "lon", lat: str = "lat") -> DataFrame:
    inside = F.col(lon).between(box["west"], box["east"]) & F.col(lat).between(box["south"], box["north"])
    return df.withColumn("in_domain", F.coalesce(inside, F.lit(False)))


def cell_geometry(cells: DataFrame, meta: dict) -> DataFrame:
    """Centres of cells; dy keeps its sign, so y may run down."""
    return cells.withColumn("lon", F.lit(meta["x0"]) + (F.col("x") + 0.5) * meta["dx"]).withColumn("lat", F.lit(meta["y0"]) + (F.col("y") + 0.5) * meta["dy"])


def nearest_cell(points: DataFrame, meta: dict, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The cell whose centre is nearest on a regular axis, in closed form; points outside go to the rim."""
    cell = lambda c, o, d, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - o) / d))).cast("int")
    return points.withColumn("x", cell(lon, meta["x0"], meta["dx"], meta["width"])).withColumn("y", cell(lat, meta["y0"], meta["dy"], meta["height"]))


#: Points of a cell that one task expands at a time.
SECTION = 8192


def extract_point(cube: DataFrame, points: DataFrame, meta: dict) -> DataFrame:
    """Series at the cells nearest to points: a row per point and date of its cell. Filters on dates and rounding belong
    to the cube, where they are done once for all points of a cell."""
    return series_of_points(nearest_cell(points, meta), cube)


def series_of_points(points: DataFrame, cube: DataFrame) -> DataFrame:
    """Rows of points (y, x, and more columns), each with the rows of its cell in the cube.

    The rows of a cell are put together in arrays of at most 4096 days each, so that points meet a few arrays and not each
    date's row, and arrays turn into rows last. A cell of many points is dealt out in sections, with its arrays for each.
    """
    cell = ["y", "x"]
    own, rest = ([c for c in df.columns if c not in cell] for df in (points, cube))
    sizes = points.groupBy(*cell).agg(F.ceil(F.count("*") / SECTION).alias("__parts"))
    span = F.floor(F.datediff("date", F.lit("1970-01-01")) / 4096).alias("__span")
    series = cube.groupBy(*cell, span).agg(F.collect_list(F.struct(*rest)).alias("__rows")).join(sizes, cell)
    series = series.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)).alias("__part"), "__rows")
    placed = points.join(sizes, cell).select(*points.columns, F.pmod(F.xxhash64(*points.columns), "__parts").alias("__part"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since few bytes become many rows
    met = placed.repartition(n, *cell, "__part").join(series.hint("merge"), [*cell, "__part"])  # point by point: a task holds one's rows
    return met.select(*cell, *own, F.inline("__rows"))


def extract_area(cube: DataFrame, bbox: dict, meta: dict) -> DataFrame:
    return area_average(cell_geometry(cube, meta), bbox)


def extract_domain(cube: DataFrame, bbox: dict, meta: dict) -> DataFrame:
    return bbox_filter(cell_geometry(cube, meta), bbox)


def axis_weights(n_src: int, o_src: float, d_src: float, n_dst: int, o_dst: float, d_dst: float, axis: str) -> Column:
    """For a target index: array of (source index, weight) of its two neighbours on one axis."""
    at = (F.lit(o_dst) + (F.col(axis) + 0.5) * d_dst - o_src) / d_src - 0.5
    low = F.floor(at)
    part = at - low
    return F.array(F.struct(low.cast("int").alias("i"), (1 - part).alias("w")), F.struct((low + 1).cast("int").alias("i"), part.alias("w")))


def target_cells(spark_df: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """All cells of a grid for each distinct key."""
    every = lambda n, a: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a)
    return spark_df.select(*keys).distinct().select(*keys, every(height, "y")).select(*keys, "y", every(width, "x"))


def regrid_bilinear(cube: DataFrame, src: dict, dst: dict, keys: list[str] = ["variable", "date"]) -> DataFrame:  # noqa: B006
    """Another regular grid by bilinear weights. Neighbours that are null or outside lose their weight; a target without
    any neighbour is null. A target cell asks for four source cells, an equi join by cell."""
    cells = target_cells(cube, dst["height"], dst["width"], keys)
    ys = axis_weights(src["height"], src["y0"], src["dy"], dst["height"], dst["y0"], dst["dy"], "y")
    xs = axis_weights(src["width"], src["x0"], src["dx"], dst["width"], dst["x0"], dst["dx"], "x")
    asked = cells.select(*keys, "y", "x", F.explode(ys).alias("a")).select(*keys, "y", "x", "a", F.explode(xs).alias("b"))
    asked = asked.select(*keys, F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("a.i").alias("y"), F.col("b.i").alias("x"), (F.col("a.w") * F.col("b.w")).alias("w")).where("w > 0")
    met = asked.join(cube.select(*keys, "y", "x", "value"), [*keys, "y", "x"], "left")
    present = F.when(F.col("value").isNotNull(), F.col("w"))
    return met.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.col("value") * F.col("w")) / F.sum(present)).alias("value"))


def regrid_nearest(cube: DataFrame, src: dict, dst: dict, keys: list[str] = ["variable", "date"]) -> DataFrame:  # noqa: B006
    """Another regular grid by the source cell that a target's centre lies in; null outside."""
    cells = target_cells(cube, dst["height"], dst["width"], keys).withColumnsRenamed({"y": "ty", "x": "tx"})
    pick = lambda t, a, o: F.floor((F.lit(dst[o]) + (F.col(t) + 0.5) * dst[a] - src[o]) / src[a]).cast("int")
    asked = cells.withColumn("y", pick("ty", "dy", "y0")).withColumn("x", pick("tx", "dx", "x0"))
    return asked.join(cube.select(*keys, "y", "x", "value"), [*keys, "y", "x"], "left").select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), "value")


def cumulative_cube(cube: DataFrame, last: DataFrame | None = None, keys: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Running sum per cell by date, continued from the last stored slice (same keys, y, x, value) if there is one."""
    w = Window.partitionBy(*keys, "y", "x").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = cube.withColumn("value", F.sum("value").over(w))
    if last is None:
        return run
    carried = last.select(*keys, "y", "x", F.col("value").alias("__carried"))
    return run.join(carried, [*keys, "y", "x"], "left").withColumn("value", F.col("value") + F.coalesce("__carried", F.lit(0.0))).drop("__carried")


def series_length_check(cubes: DataFrame, key: str = "variable") -> DataFrame:
    """Time steps per variable, and whether all have as many."""
    n = cubes.select(key, "date").distinct().groupBy(key).agg(F.count("*").alias("n_dates"))
    ends = n.agg(F.min("n_dates").alias("lo"), F.max("n_dates").alias("hi"))
    return n.crossJoin(F.broadcast(ends)).select(key, "n_dates", (F.col("lo") == F.col("hi")).alias("all_equal"))


def stack_channels(channels: dict[str, DataFrame], static: dict[str, DataFrame] | None = None) -> DataFrame:
    """One long table (date, y, x, channel, value); static layers (y, x, value) repeat for every date of the others."""
    long = reduce(DataFrame.unionByName, [df.select("date", "y", "x", F.lit(n).alias("channel"), "value") for n, df in channels.items()])
    if not static:
        return long
    dates = long.select("date").distinct()
    layers = reduce(DataFrame.unionByName, [df.select("y", "x", F.lit(n).alias("channel"), "value") for n, df in static.items()])
    return long.unionByName(layers.crossJoin(F.broadcast(dates)).select("date", "y", "x", "channel", "value"))


def binarise(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, positive(F.col(value)))
