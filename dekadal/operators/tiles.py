"""Raster cubes in tile form: (keys, ty, tx, data), where data is a square of tile x tile cells as one row-major array.

A row is a tile, so joins, groups and shuffles move arrays and never a row per cell. Tiles at the lower and right rim reach
over the grid; their cells there are null. The cell form of a cube (keys, y, x, value) is a view: ``tile_cells``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a tile: the step between the patches of the spatial model, so that a patch is a few whole tiles.
TILE = 32


def nulls(n: int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def spread(axis: str, n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis)


def grid_tiles(grids: DataFrame, height: int, width: int, tile: int = TILE, data: str = "data") -> DataFrame:
    """Tiles from rows that hold a whole grid each, as one row-major array of height x width; other columns stay."""
    rest = [c for c in grids.columns if c != data]
    placed = grids.select(*rest, data, spread("ty", -(-height // tile))).select(*rest, data, "ty", spread("tx", -(-width // tile)))
    left = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile)

    def line(r: Column) -> Column:
        y = F.col("ty") * tile + r
        own = F.slice(F.col(data), y * width + F.col("tx") * tile + 1, left)
        return F.when(y < height, F.concat(own, F.array_repeat(F.lit(None).cast("double"), F.lit(tile) - left))).otherwise(nulls(tile))

    return placed.select(*rest, "ty", "tx", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), line)).alias(data))


def cells_to_tiles(cube: DataFrame, keys: list[str], tile: int = TILE, value: str = "value") -> DataFrame:
    """Tiles from the cell form (keys, y, x, value): a group, of at most tile x tile cells, is scattered into one array. Cells
    that are not there are null; of a cell that is there twice the larger value stays."""
    size = tile * tile
    place = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int")
    by = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in ("y", "x")]
    rows = cube.select(*keys, *by, place.alias("__p"), F.col(value).cast("double").alias("__v"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def scatter(cells: pa.Table) -> pa.Table:
        out = np.full(size, np.nan)
        at, v = cells["__p"].to_numpy(), cells["__v"].to_numpy(zero_copy_only=False)
        np.fmax.at(out, at, v)
        data = pa.array([pa.array(out, mask=np.isnan(out))], pa.list_(pa.float64()))
        return cells.slice(0, 1).drop_columns(["__p", "__v"]).append_column("data", data)

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "ty", "tx"))
    return rows.groupBy(*keys, "ty", "tx").applyInArrow(scatter, f"{schema}, data array<double>")


def square_cells(squares: DataFrame, side: int, data: str = "data", value: str = "value") -> DataFrame:
    """A row per cell of square arrays, y and x counting inside the square; other columns stay."""
    rest = [c for c in squares.columns if c != data]
    at = F.posexplode(data).alias("__p", value)
    rows = squares.select(*rest, at)
    return rows.select(*rest, F.expr(f"cast(__p div {side} as int)").alias("y"), (F.col("__p") % side).cast("int").alias("x"), value)


def tile_cells(tiles: DataFrame, height: int, width: int, tile: int = TILE, value: str = "value") -> DataFrame:
    """The cell form of a cube in tiles, a view: (keys, y, x, value) of the cells of the grid."""
    rest = [c for c in tiles.columns if c not in ("ty", "tx", "data")]
    inside = square_cells(tiles, tile, value=value)
    return inside.select(*rest, (F.col("ty") * tile + F.col("y")).alias("y"), (F.col("tx") * tile + F.col("x")).alias("x"), value).where(f"y < {height} and x < {width}")


def last_dates(cube: DataFrame, steps: int, end_offset: int, keys: list[str]) -> DataFrame:
    """(keys, date, step) of the last steps dates of each key before end_offset, from the distinct dates."""
    dates = cube.select(*keys, "date").distinct()
    if not keys:
        dates = dates.orderBy(F.desc("date")).limit(steps + end_offset)
    ranked = dates.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date"))))
    wanted = ranked.where(F.col("__r").between(end_offset + 1, end_offset + steps))
    return wanted.select(*keys, "date", (F.lit(steps + end_offset) - F.col("__r")).cast("int").alias("step"))


def holders(axis: str, tile: int, size: int, stride: int, extent: int) -> Column:
    """The numbers of the patches that hold a tile, on one axis."""
    m, s, last = size // tile, stride // tile, (extent - size) // stride
    low = F.greatest(F.ceil((F.col(axis) - (m - 1)) / s), F.lit(0))
    high = F.least(F.floor(F.col(axis) / s), F.lit(last))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))


def tile_patches(
    tiles: DataFrame, height: int, width: int, size: int = 64, stride: int = 32, steps: int = 6, end_offset: int = 0,
    keys: list[str] = [], tile: int = TILE,
) -> DataFrame:  # noqa: B006
    """(keys, y0, x0, step, channel, data): overlapping patches over the last steps dates of each key, an array of size x size
    cells for each step and channel. tiles is (keys, date, channel, ty, tx, data); the side of a tile divides size and stride.

    A tile goes, as an array, to the at most (size / stride)^2 patches that hold it, and a patch is put together from its
    (size / tile)^2 tiles. Cells without a tile are null, and a patch without any tile is not there.
    """
    if size % tile or stride % tile:
        raise ValueError(f"tiles of {tile} do not divide patches of {size} every {stride}")
    m, s = size // tile, stride // tile
    ranked = last_dates(tiles, steps, end_offset, keys)
    rows = tiles.join(ranked if keys else F.broadcast(ranked), [*keys, "date"])
    rows = rows.withColumn("__ky", F.explode(holders("ty", tile, size, stride, height))).withColumn("__kx", F.explode(holders("tx", tile, size, stride, width)))
    part = ((F.col("ty") - F.col("__ky") * s) * m + F.col("tx") - F.col("__kx") * s).cast("int").alias("part")
    start = [(F.col(f"__k{a}") * stride).cast("int").alias(f"{a}0") for a in ("y", "x")]
    parts = F.collect_list(F.struct("part", "data")).alias("__parts")
    joined = rows.select(*keys, *start, "step", "channel", part, "data").groupBy(*keys, "y0", "x0", "step", "channel").agg(parts)
    return joined.select(*keys, "y0", "x0", "step", "channel", stitched(F.col("__parts"), m, tile).alias("data"))


def stitched(parts: Column, m: int, tile: int) -> Column:
    """One array of m x m tiles from (part, data) of those that are there."""
    own = lambda k: F.coalesce(F.get(F.filter(parts, lambda p: p["part"] == k), 0)["data"], nulls(tile * tile))

    def rows(full: Column) -> Column:
        line = lambda y, j: F.slice(F.get(full, F.floor(y / tile).cast("int") * m + j), F.pmod(y, F.lit(tile)) * tile + 1, tile)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m * tile - 1)), lambda y: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: line(y, j)))))

    return let(F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), own), rows)


def patch_samples(patches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, y0, x0, sample): the steps and channels of a patch one after another in one array, as a model takes them."""
    layers = F.array_sort(F.collect_list(F.struct("step", "channel", "data")))
    return patches.groupBy(*keys, "y0", "x0").agg(layers.alias("__l")).select(*keys, "y0", "x0", F.flatten(F.transform("__l", lambda x: x["data"])).alias("sample"))


def cropped(data: Column, size: int, border: int) -> Column:
    """A patch whose rim is null."""
    kept = lambda i: (F.floor(i / size).between(border, size - border - 1)) & (F.pmod(i, F.lit(size)).between(border, size - border - 1))
    return F.transform(data, lambda v, i: F.when(kept(i), v))


def tile_mosaic(
    patches: DataFrame, height: int, width: int, size: int, border: int = 4, keys: list[str] = [], tile: int = TILE,
    data: str = "data",
) -> DataFrame:  # noqa: B006
    """(keys, ty, tx, data): mean over the patches, without their rims, that cover a cell; null where none does. patches is
    (keys, y0, x0, data), starts are multiples of the tile's side.

    A patch is cut into its tiles, and a tile of the mosaic is a group of the few patches that hold it: as many arrays as
    patches overlap, of which means are taken cell by cell.
    """
    m = size // tile
    rows = patches.select(*keys, "y0", "x0", cropped(F.col(data), size, border).alias("__d"), spread("__j", m * m))
    dy, dx = F.floor(F.col("__j") / m), F.col("__j") % m
    line = lambda r: F.slice("__d", ((dy * tile + r) * size + dx * tile + 1).cast("int"), tile)
    own = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), line)).alias("data")
    at = lambda a, d: (F.floor(F.col(a) / tile) + d).cast("int")
    cut = rows.select(*keys, at("y0", dy).alias("ty"), at("x0", dx).alias("tx"), own)
    every = F.collect_list("data").alias("__all")

    def mean(p: Column) -> Column:
        total = F.aggregate("__all", F.lit(0.0), lambda a, d: a + F.coalesce(F.get(d, p), F.lit(0.0)))
        n = F.aggregate("__all", F.lit(0), lambda a, d: a + F.get(d, p).isNotNull().cast("int"))
        return F.when(n > 0, total / n)

    means = cut.groupBy(*keys, "ty", "tx").agg(every).select(*keys, "ty", "tx", F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), mean).alias("data"))
    keyed = patches.select(*keys).distinct() if keys else patches.sparkSession.range(1).drop("id")
    grid = keyed.select("*", spread("ty", -(-height // tile))).select("*", spread("tx", -(-width // tile)))
    return grid.join(means, [*keys, "ty", "tx"], "left").withColumn("data", F.coalesce("data", nulls(tile * tile)))


def axis_weights(n_src: int, o_src: float, d_src: float, n_dst: int, o_dst: float, d_dst: float) -> np.ndarray:
    """(target, source, weight) of one axis between two grids: the two neighbours of each target that are in the grid and
    have a weight. Made once, for all dates."""
    at = ((o_dst + (np.arange(n_dst) + 0.5) * d_dst) - o_src) / d_src - 0.5
    low = np.floor(at)
    rows = np.concatenate([np.stack([np.arange(n_dst), low, 1 - (at - low)], 1), np.stack([np.arange(n_dst), low + 1, at - low], 1)])
    return rows[(rows[:, 1] >= 0) & (rows[:, 1] < n_src) & (rows[:, 2] > 0)]


def tile_regrid(tiles: DataFrame, src: dict, dst: dict, keys: list[str] = ["variable", "date"], tile: int = TILE) -> DataFrame:  # noqa: B006
    """(keys, ty, tx, data): another regular grid by bilinear weights. Neighbours that are null or outside lose their weight;
    a target without any neighbour is null. Targets of a key that has any tile are all there.

    Weights are separable: a sparse table per axis, made once for two grids. Which source tiles a target tile needs follows
    from it, a table of as many rows as the grid's sides have tiles; each source tile goes, as an array, to the targets
    that need it, and a target tile is a product of its weights of rows, its source cells and its weights of columns.
    """
    axes = {a: axis_weights(src[n], src[o], src[d], dst[n], dst[o], dst[d]) for a, n, o, d in (("y", "height", "y0", "dy"), ("x", "width", "x0", "dx"))}
    spark = tiles.sparkSession
    rows = tiles.select(*keys, F.col("ty").alias("__sy"), F.col("tx").alias("__sx"), "data")
    for a, w in axes.items():
        pairs = np.unique((w[:, :2] // tile).astype(np.int32), axis=0)
        need = spark.createDataFrame(pa.table({f"t{a}": pa.array(pairs[:, 0]), f"__s{a}": pa.array(pairs[:, 1])}))
        rows = rows.join(F.broadcast(need), f"__s{a}")  # rows by the tiles of one side of the grids
    met = rows.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("__sy", "__sx", "data")).alias("__parts"))
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def matrix(axis: str, t: int, first: int, n: int) -> np.ndarray:
        """Weights of a target tile's rows (or columns) over n source tiles from the first."""
        w = axes[axis]
        w = w[(w[:, 0] // tile == t) & (w[:, 1] // tile >= first) & (w[:, 1] // tile < first + n)]
        out = np.zeros((tile, n * tile))
        out[(w[:, 0] - t * tile).astype(int), (w[:, 1] - first * tile).astype(int)] = w[:, 2]
        return out

    def product(batches):
        made: dict = {}  # the weights of the target tiles so far: as many as one side has tiles, for each axis

        def weights(*key) -> np.ndarray:
            if key not in made:
                made[key] = matrix(*key)
            return made[key]

        for batch in batches:
            out = []
            for ty, tx, parts in zip(batch["ty"].to_pylist(), batch["tx"].to_pylist(), batch["__parts"], strict=True):
                sy, sx, data = (parts.values.field(k) for k in range(3))
                sy, sx = sy.to_numpy(), sx.to_numpy()
                ny, nx = (int(s.max() - s.min()) + 1 for s in (sy, sx))
                block = np.full((ny * tile, nx * tile), np.nan)
                for k, (y, x) in enumerate(zip(sy - sy.min(), sx - sx.min(), strict=True)):
                    block[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] = data[k].values.to_numpy(zero_copy_only=False).reshape(tile, tile)
                wy, wx = weights("y", ty, int(sy.min()), ny), weights("x", tx, int(sx.min()), nx)
                there = ~np.isnan(block)
                total, weight = wy @ np.where(there, block, 0.0) @ wx.T, wy @ there @ wx.T
                found = np.divide(total, weight, out=np.full_like(total, np.nan), where=weight > 0).ravel()
                out.append(pa.array(found, mask=np.isnan(found)))
            yield batch.drop_columns(["__parts"]).append_column("data", pa.array(out, pa.list_(pa.float64())))

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "ty", "tx"))
    made = met.mapInArrow(product, f"{schema}, data array<double>")
    every = tiles.select(*keys).distinct().select("*", spread("ty", -(-dst["height"] // tile))).select("*", spread("tx", -(-dst["width"] // tile)))
    return every.join(made, [*keys, "ty", "tx"], "left").withColumn("data", F.coalesce("data", nulls(tile * tile)))
