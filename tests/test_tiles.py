"""Cubes in tile form against their cell form."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from dekadal.operators import grid, patches, tiles
from dekadal.plans import catalog, grid_queries

H, W = 11, 13


@pytest.fixture(scope="module")
def cube(spark):
    """Five dates on a grid that no tile divides, with null cells and cells that are not there."""
    rng = random.Random(1)
    rows = [("v", datetime.date(2020, 1, 1 + d), y, x, "c", None if rng.random() < 0.1 else rng.random()) for d in range(5) for y in range(H) for x in range(W) if rng.random() < 0.97]
    return spark.createDataFrame(rows, "variable string, date date, y int, x int, channel string, value double").cache()


def near(got, want, keys):
    a, b = ({tuple(r[:-1]): r[-1] for r in df.select(*keys, "value").collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 100
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-12) for k in a)


def test_cells_and_tiles_are_views_of_each_other(spark, cube):
    for tile in (2, 4, 32):
        back = tiles.tile_cells(tiles.cells_to_tiles(cube, ["variable", "date"], tile), H, W, tile).where("value is not null")
        near(back, cube.where("value is not null"), ["date", "y", "x"])
    grids = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(H * W - 1)), lambda i: i.cast("double")).alias("data"))
    cells = tiles.tile_cells(tiles.grid_tiles(grids, H, W, 4), H, W, 4).select("id", "y", "x", "value")
    assert sorted(map(tuple, cells.collect())) == [(i, y, x, float(y * W + x)) for i in range(3) for y in range(H) for x in range(W)]


def test_a_cell_that_is_there_twice_keeps_the_larger_value(spark):
    rows = [(0, 0, 1.0), (0, 0, 3.0), (0, 1, None), (0, 1, -2.0), (1, 1, None)]
    got = tiles.cells_to_tiles(spark.createDataFrame(rows, "y int, x int, value double").withColumn("k", F.lit(1)), ["k"], 2)
    assert [r.data for r in got.collect()] == [[3.0, -2.0, None, None]]


@pytest.mark.parametrize("size,stride,tile", [(6, 4, 2), (4, 4, 4), (4, 2, 1)])
def test_patches_and_mosaics(cube, size, stride, tile):
    made = tiles.tile_patches(tiles.cells_to_tiles(cube, ["variable", "date", "channel"], tile), H, W, size, stride, 3, 1, ["variable"], tile)
    pixels = tiles.square_cells(made, size)
    cells = patches.patch_pixels(patches.patch_windows(cube, H, W, size, stride, 3, 1, ["variable"]), ["variable"])
    near(pixels.where("value is not null"), cells.where("value is not null"), ["variable", "y0", "x0", "step", "channel", "y", "x"])
    mosaic = tiles.tile_mosaic(made, H, W, size, 1, ["variable", "step"], tile)
    near(tiles.tile_cells(mosaic, H, W, tile), patches.mosaic_mean(pixels, H, W, size, 1, ["variable", "step"]), ["variable", "step", "y", "x"])


def test_a_mosaic_of_patches_is_the_grid(spark):
    rows = [(datetime.date(2020, 1, 1), y, x, "c", float(10 * y + x)) for y in range(8) for x in range(8)]
    cube = spark.createDataFrame(rows, "date date, y int, x int, channel string, value double")
    made = tiles.tile_patches(tiles.cells_to_tiles(cube, ["date", "channel"], 2), 8, 8, 4, 2, steps=1, tile=2)
    whole = tiles.tile_cells(tiles.tile_mosaic(made, 8, 8, 4, border=0, tile=2), 8, 8, 2)
    assert {(r.y, r.x): r.value for r in whole.collect()} == {(y, x): v for _, y, x, _, v in rows}
    rim = tiles.tile_cells(tiles.tile_mosaic(made, 8, 8, 4, border=1, tile=2), 8, 8, 2)
    assert rim.where("value is null").count() == 64 - 36


def test_samples_hold_steps_and_channels_in_order(spark):
    rows = [(0, 0, s, c, [float(10 * s + k)]) for k, c in enumerate("ab") for s in (1, 0)]
    got = tiles.patch_samples(spark.createDataFrame(rows, "y0 int, x0 int, step int, channel string, data array<double>"))
    assert [r["sample"] for r in got.collect()] == [[0.0, 1.0, 10.0, 11.0]]


def test_patches_of_other_steps_are_refused(cube):
    with pytest.raises(ValueError):
        tiles.tile_patches(tiles.cells_to_tiles(cube, ["date", "channel"], 4), H, W, 6, 4, tile=4)


FINE = {"x0": -1.0, "y0": 12.0, "dx": 0.37, "dy": -0.41, "height": 31, "width": 33}
COARSE = {"x0": 1.0, "y0": 0.3, "dx": 0.7, "dy": 1.9, "height": 5, "width": 37}  # upside down


@pytest.mark.parametrize("target,tile", [(FINE, 2), (FINE, 4), (COARSE, 4), (COARSE, 32)])
def test_regridded_tiles(cube, target, tile):
    src = {"x0": 0.0, "y0": 11.0, "dx": 1.0, "dy": -1.0, "height": H, "width": W}
    made = tiles.tile_regrid(tiles.cells_to_tiles(cube, ["variable", "date"], tile), src, target, tile=tile)
    near(tiles.tile_cells(made, target["height"], target["width"], tile), grid.regrid_bilinear(cube, src, target), ["date", "y", "x"])


def test_empty_tables(spark, cube):
    none = tiles.cells_to_tiles(cube.limit(0), ["variable", "date", "channel"], 2)
    assert none.count() == 0 and tiles.tile_patches(none, H, W, 4, 2, tile=2).count() == 0
    assert tiles.tile_mosaic(tiles.tile_patches(none, H, W, 4, 2, keys=["variable"], tile=2), H, W, 4, keys=["variable"], tile=2).count() == 0
    assert tiles.tile_regrid(none.drop("channel"), {**FINE}, COARSE, tile=2).count() == 0


@pytest.mark.parametrize("name", ["patch_windows", "mosaic_mean", "regrid_bilinear"])
def test_no_row_per_cell_before_the_view(spark, tmp_path, name):
    """The only rows of cells are those that leave the query: below the last explode, rows are tiles."""
    rows = [(i, [float(k) for k in range(64)], i % 2) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and plan.index("posexplode") < (plan.index("Join") if "Join" in plan else len(plan)) and plan.index("posexplode") < plan.index("Aggregate")
    tiled = grid_queries.labelled_patches(spark, str(tmp_path))
    assert tiled.count() == 2 * 9 * 3 and all(len(r.data) == 16 for r in tiled.collect())
