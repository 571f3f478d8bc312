"""Regions as rings of points, without a geometry library: boxes first, then the even-odd rule.

``regions(region, ring_id, is_hole, pts array<struct<x, y>>)``; rings need not repeat their first point. The even-odd
rule over all rings of a region makes holes holes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def region_bbox(regions: DataFrame, pad: tuple[float, float, float, float] = (0, 0, 0, 0)) -> DataFrame:
    """Least and largest x, y per region, padded by shares of width and height: left, right, bottom, top."""
    ends = {"xmin": F.min("p.x"), "xmax": F.max("p.x"), "ymin": F.min("p.y"), "ymax": F.max("p.y")}
    b = regions.select("region", F.explode("pts").alias("p")).groupBy("region").agg(*[v.alias(k) for k, v in ends.items()])
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    grow = {"xmin": -w * pad[0], "xmax": w * pad[1], "ymin": -h * pad[2], "ymax": h * pad[3]}
    return b.select("region", *[(F.col(c) + by).alias(c) for c, by in grow.items()])


def edges(pts: Column) -> Column:
    """Edges (ax, ay, bx, by) of a closed ring."""
    closed = F.concat(F.slice(pts, F.lit(2), F.size(pts) - 1), F.slice(pts, 1, 1))
    return F.zip_with(pts, closed, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def region_edges(regions: DataFrame) -> DataFrame:
    """(region, e): a row for every edge of every ring."""
    return regions.select("region", F.explode(edges(F.col("pts"))).alias("e"))


def outlines(sides: DataFrame) -> DataFrame:
    """A row per region: the box around its edges, and into how many slabs of one height its box is cut, __k: as many as it
    has edges, and fewer where long edges would lie in many, so that all its slabs together hold at most twice its edges
    (and one for each)."""
    low = lambda a: F.least(f"e.a{a}", f"e.b{a}")
    high = lambda a: F.greatest(f"e.a{a}", f"e.b{a}")
    box = {"__x0": F.min(low("x")), "__x1": F.max(high("x")), "__y0": F.min(low("y")), "__y1": F.max(high("y"))}
    tall = F.sum(high("y") - low("y")).alias("__tall")
    rows = sides.groupBy("region").agg(*[v.alias(k) for k, v in box.items()], F.count("*").alias("__n"), tall)
    k = F.floor(F.col("__n") * (F.col("__y1") - F.col("__y0")) / F.nullif("__tall", F.lit(0.0)))
    return rows.withColumn("__k", F.greatest(F.lit(1).cast("long"), F.least(F.coalesce(k, F.lit(1).cast("long")), F.col("__n")))).drop("__n", "__tall")


def slab(y: Column) -> Column:
    """The slab of its region's box that a height lies in."""
    tall = F.nullif(F.col("__y1") - F.col("__y0"), F.lit(0.0))
    at = F.floor((y - F.col("__y0")) / tall * F.col("__k"))
    return F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(at, F.lit(0).cast("long")), F.col("__k") - 1))


def slabs(sides: DataFrame, shapes: DataFrame) -> DataFrame:
    """(region, __slab, __edges): the edges that a slab of a region holds parts of, and no others."""
    low, high = F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by")
    placed = sides.join(shapes, "region").withColumn("__slab", F.explode(F.sequence(slab(low), slab(high))))
    return placed.groupBy("region", "__slab").agg(F.collect_list("e").alias("__edges"))


def crossed(x: Column, y: Column) -> Column:
    """How many of the __edges a ray to the right of the point crosses."""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        return spans & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(spans, e["by"] - e["ay"]) + e["ax"])

    return F.size(F.filter("__edges", crosses))


#: Buckets of a coarse grid, in each direction, that the box of one region may reach over.
REACH = 256


def near_regions(points: DataFrame, shapes: DataFrame, x: str, y: str) -> DataFrame:
    """Each point with the regions in whose box it lies, and its slab there: an equi-join on the buckets of a coarse grid. A
    point has one bucket, and a region those of its box; buckets are as wide as a mean box, and wide enough for the largest
    box to have at most REACH x REACH of them."""
    wide = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    width = F.greatest(F.avg(wide), F.max(wide) / REACH, F.lit(1e-9)).alias("__w")
    one = F.broadcast(shapes.agg(width))  # one row
    bucket = lambda c: F.floor(F.col(c) / F.col("__w"))
    reach = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b)))
    cells = shapes.crossJoin(one).withColumn("__bx", reach("__x0", "__x1")).withColumn("__by", reach("__y0", "__y1")).drop("__w")
    placed = points.crossJoin(one).withColumns({"__bx": bucket(x), "__by": bucket(y)}).drop("__w")
    met = placed.join(cells, ["__bx", "__by"]).where(f"`{x}` between __x0 and __x1 and `{y}` between __y0 and __y1")
    return met.select(*points.columns, "region", slab(F.col(y)).alias("__slab"))


def touches(e: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether an edge meets a box: Liang-Barsky clipping without branches."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]

    def side(d: Column, lo: Column, hi: Column, a: Column) -> tuple[Column, Column, Column]:
        near = F.when(d > 0, (lo - a) / F.nullif(d, F.lit(0.0))).when(d < 0, (hi - a) / F.nullif(d, F.lit(0.0))).otherwise(F.lit(0.0))
        far = F.when(d > 0, (hi - a) / F.nullif(d, F.lit(0.0))).when(d < 0, (lo - a) / F.nullif(d, F.lit(0.0))).otherwise(F.lit(1.0))
        return near, far, (d != 0) | ((a >= lo) & (a <= hi))

    nx, fx, okx = side(dx, x0, x1, e["ax"])
    ny, fy, oky = side(dy, y0, y1, e["ay"])
    return okx & oky & (F.greatest(nx, ny, F.lit(0.0)) <= F.least(fx, fy, F.lit(1.0)))


def centre(axis: str, meta: dict, index: Column) -> Column:
    """The coordinate of a cell's centre, as cell_geometry has it."""
    return F.lit(meta[f"{axis}0"]) + (index + 0.5) * meta[f"d{axis}"]


def between(axis: str, meta: dict, a: Column, b: Column) -> Column:
    """The indices of the given cells whose extent on an axis may meet [a, b]; one more at each end, for rounding."""
    at = lambda c: F.floor((c - meta[f"{axis}0"]) / meta[f"d{axis}"]).cast("long")
    low = F.greatest(F.least(at(a), at(b)) - 1, F.col(f"__{axis}min").cast("long"))
    high = F.least(F.greatest(at(a), at(b)) + 1, F.col(f"__{axis}max").cast("long"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))


def filled_rows(sides: DataFrame, ends: DataFrame, meta: dict) -> DataFrame:
    """(region, y, x) of the cells whose centre is inside, by scan lines: an edge has one crossing with the line of each row
    of cells that it spans; sorted along a line, crossings bound the inside in pairs, and the cells between a pair are a
    range. Work follows the edges' heights in rows and the cells that are inside, not their product."""
    lines = sides.crossJoin(ends).withColumn("y", F.explode(between("y", meta, F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by"))))
    line = centre("y", meta, F.col("y"))
    spans = (F.col("e.ay") > line) != (F.col("e.by") > line)
    at = (F.col("e.bx") - F.col("e.ax")) * (line - F.col("e.ay")) / F.when(spans, F.col("e.by") - F.col("e.ay")) + F.col("e.ax")
    along = Window.partitionBy("region", "y").orderBy("a")
    pairs = lines.where(spans).select("region", "y", at.alias("a"), "__xmin", "__xmax")
    pairs = pairs.withColumns({"b": F.lead("a").over(along), "i": F.row_number().over(along)}).where("i % 2 = 1 and a < b")
    cells = pairs.withColumn("x", F.explode(between("x", meta, F.col("a"), F.col("b"))))
    return cells.where((centre("x", meta, F.col("x")) >= F.col("a")) & (centre("x", meta, F.col("x")) < F.col("b"))).select("region", "y", "x")


def touched_cells(sides: DataFrame, ends: DataFrame, meta: dict) -> DataFrame:
    """(region, y, x) of the cells that edges meet: an edge is walked row by row of cells, and in each row over the columns
    that its part there reaches; a cell that several edges meet comes several times."""
    hx, hy = abs(meta["dx"]) / 2, abs(meta["dy"]) / 2
    rows = sides.crossJoin(ends).withColumn("y", F.explode(between("y", meta, F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by"))))
    line, tall = centre("y", meta, F.col("y")), F.nullif(F.col("e.by") - F.col("e.ay"), F.lit(0.0))
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    along = lambda y, flat: F.col("e.ax") + (F.col("e.bx") - F.col("e.ax")) * F.coalesce(clip((y - F.col("e.ay")) / tall), F.lit(flat))
    reach = rows.withColumn("x", F.explode(between("x", meta, along(line - hy, 0.0), along(line + hy, 1.0))))
    x = centre("x", meta, F.col("x"))
    return reach.where(touches(F.col("e"), x - hx, x + hx, line - hy, line + hy)).select("region", "y", "x")


def rasterize_region(cells: DataFrame, regions: DataFrame, meta: dict, all_touched: bool = True) -> DataFrame:
    """(region, y, x) of the cells in a region: by their centre or, with all_touched, by any touch of its edges too. A cell
    that cells repeats is one cell. No cell meets an edge that does not run by it: see filled_rows and touched_cells."""
    own = cells.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    ends = F.broadcast(own.agg(*[f(a).alias(f"__{a}{n}") for a in "yx" for n, f in (("min", F.min), ("max", F.max))]))  # one row
    sides = region_edges(regions)
    found = filled_rows(sides, ends, meta)
    if all_touched:
        found = found.union(touched_cells(sides, ends, meta)).distinct()
    return found.select("region", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).join(own, ["y", "x"], "left_semi").select("region", "y", "x")


def mask_cube(cube: DataFrame, region_cells: DataFrame, drop: bool = True) -> DataFrame:
    """Cells of each region; with drop=False all cells of the cube per region, null outside."""
    if drop:
        return cube.join(region_cells, ["y", "x"])
    every = cube.crossJoin(F.broadcast(region_cells.select("region").distinct()))
    inside = region_cells.withColumn("__in", F.lit(True))
    return every.join(inside, ["region", "y", "x"], "left").withColumn("value", F.when(F.col("__in"), F.col("value"))).drop("__in")


def zonal_mean(cube: DataFrame, region_cells: DataFrame, keys: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Per region and date: sum of the cells by the cells that are present."""
    return cube.join(region_cells, ["y", "x"]).groupBy(*keys, "region", "date").agg(F.avg("value").alias("value"))


def clip_to_geometry(
    cube: DataFrame, region_cells: DataFrame, fill: float = 0.0, keys: list[str] = ["variable", "date"],
) -> DataFrame:  # noqa: B006
    """The box of the region's cells, indices from 0; cells in the box but outside the region hold the fill value."""
    cells = region_cells.select("y", "x").distinct()
    box = cells.agg(F.min("y").alias("__y0"), F.max("y").alias("__y1"), F.min("x").alias("__x0"), F.max("x").alias("__x1"))
    boxed = cube.crossJoin(F.broadcast(box)).where("y between __y0 and __y1 and x between __x0 and __x1")
    joined = boxed.join(cells.withColumn("__in", F.lit(True)), ["y", "x"], "left")
    value = F.when(F.col("__in"), F.col("value")).otherwise(F.lit(fill))
    return joined.select(*keys, (F.col("y") - F.col("__y0")).alias("y"), (F.col("x") - F.col("__x0")).alias("x"), value.alias("value"))


def spatial_join_points(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(point columns, region) of the points inside a region, a row for each that a point has; rows that repeat a point
    stay; rings of one region count together. Boxes first; then a point meets the edges of its own slab of the region's
    box, twice as many, on average, as a line of that height crosses, however many the ring has."""
    sides = region_edges(regions)
    shapes = outlines(sides)
    near = near_regions(points, shapes, x, y).join(slabs(sides, shapes), ["region", "__slab"])
    return near.where(crossed(F.col(x), F.col(y)) % 2 == 1).select(*points.columns, "region")


def region_filter(df: DataFrame, region: str, name: str = "region") -> DataFrame:
    """Rows of one region; reading them fails if there are none."""
    own = df.where(F.col(name) == region)
    found = own.agg(F.count("*").alias("__n")).select(F.assert_true(F.col("__n") > 0, F.lit(f"no rows of region {region}")).alias("__ok"))
    return own.join(F.broadcast(found), F.col("__ok").isNull()).drop("__ok")


def union_regions(layers: list[DataFrame]) -> DataFrame:
    """Layers stacked on the columns that all have."""
    common = [c for c in layers[0].columns if all(c in d.columns for d in layers)]
    return reduce(DataFrame.unionByName, [d.select(common) for d in layers])
