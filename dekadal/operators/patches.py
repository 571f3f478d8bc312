"""Overlapping patches and mosaics in cell form, for small grids (tiles.py has them for large ones), rank masks and change
maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import change_class
from .tiles import last_dates

#: Value buckets of the first pass of rank_mask.
BUCKETS = 4096


def starts(axis: str, size: int, stride: int, extent: int) -> Column:
    """Starts of the patches that hold an index: multiples of the stride whose patch lies in the grid."""
    last = (extent - size) // stride
    low = F.greatest(F.ceil((F.col(axis) - (size - 1)) / stride), F.lit(0))
    high = F.least(F.floor(F.col(axis) / stride), F.lit(last))
    return F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda k: (k * stride).cast("int"))


def patch_windows(
    cube: DataFrame, height: int, width: int, size: int = 64, stride: int = 32, steps: int = 6, end_offset: int = 0,
    keys: list[str] = [],
) -> DataFrame:  # noqa: B006
    """(keys, y0, x0, data) of the patches over the last ``steps`` dates of each key before end_offset: data is sorted (step,
    channel, y, x, value) with y and x inside the patch. The cube is long: (keys, date, y, x, channel, value).

    The wanted dates are ranked in a small table of distinct dates, per key if there are keys; a cell goes to at most
    (size / stride)^2 patches and each patch is one group of steps * channels * size^2 values. The table per key is
    joined without a hint: there may be any number of keys.
    """
    ranked = last_dates(cube, steps, end_offset, keys)
    rows = cube.join(ranked if keys else F.broadcast(ranked), [*keys, "date"])
    rows = rows.withColumn("y0", F.explode(starts("y", size, stride, height))).withColumn("x0", F.explode(starts("x", size, stride, width)))
    value = F.struct("step", "channel", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "value")
    return rows.groupBy(*keys, "y0", "x0").agg(F.array_sort(F.collect_list(value)).alias("data"))


def patch_pixels(patches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return patches.select(*keys, "y0", "x0", F.inline("data"))


def crop_border(pixels: DataFrame, size: int, border: int = 4) -> DataFrame:
    """Pixels without a rim of each patch; y and x count inside the patch."""
    return pixels.where(f"y between {border} and {size - border - 1} and x between {border} and {size - border - 1}")


def mosaic_mean(
    pixels: DataFrame, height: int, width: int, size: int, border: int = 4, keys: list[str] = [],
    value: str = "value",
) -> DataFrame:  # noqa: B006
    """Mean over the cropped patches that cover a cell, on the full grid; cells without a patch are null."""
    inner = crop_border(pixels, size, border)
    means = inner.groupBy(*keys, (F.col("y0") + F.col("y")).alias("y"), (F.col("x0") + F.col("x")).alias("x")).agg(F.avg(value).alias(value))
    keyed = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).drop("id")
    grid = keyed.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(*keys, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.join(means, [*keys, "y", "x"], "left")


def rank_mask(
    prob: DataFrame, pct: DataFrame | float, keys: list[str] = ["scenario"], value: str = "value",
    denominator: str = "valid",
) -> DataFrame:  # noqa: B006
    """The top cells by value as 0/1: n = round half even(pct * cells), ties of the n-th included, n = 0 is empty.

    Two passes, so that no task ranks a whole map: cells are counted in 4096 value buckets per key, the bucket with the
    n-th cell is found among these counts, and only its cells are ranked. pct is a number or a table (keys, pct). The
    per-key tables are joined without hints: there may be any number of keys.
    """
    rows = prob.join(pct, keys) if isinstance(pct, DataFrame) else prob.withColumn("pct", F.lit(float(pct)))
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__valid"), F.count("*").alias("__all"), F.first("pct").alias("__pct"))
    total = F.col("__valid") if denominator == "valid" else F.col("__all")
    ends = ends.withColumn("__n", F.bround(F.col("__pct") * total).cast("long")).drop("__pct", "__all")
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    bucket = F.least(F.coalesce(F.floor((F.col(value) - F.col("__lo")) / width * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
    placed = rows.drop("pct").join(ends, keys).withColumn("__b", F.when(F.col(value).isNotNull(), bucket))
    counts = placed.where("__b is not null").groupBy(*keys, "__b", "__n").agg(F.count("*").alias("__c"))
    above = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__above", above).where("__above < __n and __n <= __above + __c").select(*keys, F.col("__b").alias("__cut"), "__above")
    inside = placed.join(cut, keys).where("__b = __cut")
    ranked = inside.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))) + F.col("__above"))
    edge = ranked.where("__rank <= __n").groupBy(*keys).agg(F.min(value).alias("__edge"))
    return placed.join(edge, keys, "left").withColumn("flooded", F.coalesce((F.col(value) >= F.col("__edge")).cast("int"), F.lit(0))).drop("__lo", "__hi", "__valid", "__n", "__b", "__edge")


def scenario_masks(prob: DataFrame, forecast: DataFrame, denominator: str = "valid") -> DataFrame:
    """(scenario, y, x, flooded): worst from the upper bound, average from the mean and best from the lower bound of the
    last forecast date; prob is (y, x, value)."""
    last = forecast.orderBy(F.desc("date")).limit(1)
    pct = last.select(F.expr("stack(3, 'worst', upper_bound_95, 'average', level, 'best', lower_bound_95) as (scenario, pct)"))
    return rank_mask(prob.crossJoin(F.broadcast(pct.select("scenario"))), pct, denominator=denominator).select("scenario", "y", "x", "flooded")


def flood_change_map(current: DataFrame, masks: DataFrame, region_cells: DataFrame | None = None) -> DataFrame:
    """Class of change per cell from the current extent (y, x, value) and the three scenario masks; with region cells,
    per region."""
    wide = masks.groupBy("y", "x").pivot("scenario", ["worst", "average", "best"]).agg(F.max("flooded"))
    rows = current.select("y", "x", (F.col("value") > 0).cast("int").alias("current")).join(wide, ["y", "x"])
    out = rows.withColumn("change", change_class(F.col("current"), F.col("worst"), F.col("average"), F.col("best")))
    return out if region_cells is None else out.join(region_cells, ["y", "x"])


def change_area(change: DataFrame, keys: list[str] = ["region"]) -> DataFrame:  # noqa: B006
    """Cells per class, with totals per key (class null) by rollup."""
    return change.rollup(*keys, "change").agg(F.count("*").alias("n_cells"))
