"""Polygons without a geometry library."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from dekadal.operators import grid, region

META = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "height": 6, "width": 6}


def polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("square", 0, False, ring((0, 0), (6, 0), (6, 6), (0, 6))), ("square", 1, True, ring((2, 2), (4, 2), (4, 4), (2, 4))), ("corner", 0, False, ring((0.2, 0.2), (0.3, 0.2), (0.3, 0.3)))]
    return spark.createDataFrame(rows, "region string, ring_id int, is_hole boolean, pts array<struct<x double, y double>>")


def cells(spark):
    return spark.range(36).select((F.col("id") / 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"))


def test_hole_and_touch(spark):
    got = {(r.region, r.y, r.x) for r in region.rasterize_region(cells(spark), polygons(spark), META, all_touched=False).collect()}
    assert len(got) == 32 and ("square", 2, 2) not in got
    touched = {(r.region, r.y, r.x) for r in region.rasterize_region(cells(spark), polygons(spark), META).collect()}
    assert ("corner", 0, 0) in touched and ("corner", 1, 1) not in touched and got <= touched


def test_points_and_boxes(spark):
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.0, 1.0), (3, 9.0, 9.0)], "id int, x double, y double")
    assert [(r.id, r.region) for r in region.spatial_join_points(points, polygons(spark)).collect()] == [(2, "square")]
    box = region.region_bbox(polygons(spark), (0.1, 0, 0, 0)).where("region = 'square'").first()
    assert (box.xmin, box.xmax) == (-0.6000000000000001, 6.0) or abs(box.xmin + 0.6) < 1e-9


def test_repeated_points_stay_and_repeated_cells_are_one(spark):
    places = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, 5.0), ("b", 5.0, 5.0), ("c", 3.0, 3.0), ("d", None, 1.0)], "name string, x double, y double")
    got = sorted((r.name, r.region) for r in region.spatial_join_points(places, polygons(spark)).collect())
    assert got == [("a", "square"), ("b", "square"), ("b", "square")]
    twice = cells(spark).union(cells(spark))
    for touched in (False, True):
        once = sorted(map(tuple, region.rasterize_region(cells(spark), polygons(spark), META, touched).collect()))
        assert sorted(map(tuple, region.rasterize_region(twice, polygons(spark), META, touched).collect())) == once


def test_boxes_of_any_size_meet_their_points(spark):
    """Against every point and region: boxes from a speck to the whole plane, points on both sides of zero."""
    rng = random.Random(6)
    rings = [(f"r{k}", 0, False, [{"x": x + w * a, "y": y + w * b} for a, b in ((0, 0), (1, 0.2), (0.7, 1), (0.1, 0.8))]) for k in range(40) for x, y, w in [(rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-2, 2))]]
    table = spark.createDataFrame(rings, "region string, ring_id int, is_hole boolean, pts array<struct<x double, y double>>")
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(400)]

    def inside(x, y, pts):
        odd = False
        for a, b in zip(pts, [*pts[1:], pts[0]], strict=True):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
        return odd

    want = sorted((i, r) for i, x, y in points for r, _, _, pts in rings if inside(x, y, pts))
    found = region.spatial_join_points(spark.createDataFrame(points, "id int, x double, y double"), table)
    assert sorted((r.id, r.region) for r in found.collect()) == want and len(want) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan


def test_zonal_mean_skips_nulls(spark):
    cube = cells(spark).withColumn("variable", F.lit("v")).withColumn("date", F.lit("2020-01-01").cast("date")).withColumn("value", F.when(F.col("x") > 0, F.col("x").cast("double")))
    own = region.rasterize_region(cells(spark), polygons(spark), META, all_touched=False)
    got = region.zonal_mean(cube, own).first().value
    values = [x for y in range(6) for x in range(1, 6) if not (2 <= y < 4 and 2 <= x < 4)]
    assert abs(got - sum(values) / len(values)) < 1e-12


def test_bilinear_keeps_a_plane(spark):
    rows = cells(spark).withColumn("variable", F.lit("v")).withColumn("date", F.lit("2020-01-01").cast("date")).withColumn("value", F.col("x") * 2.0 + F.col("y"))
    fine = {"x0": 0.0, "y0": 0.0, "dx": 0.5, "dy": 0.5, "height": 12, "width": 12}
    for r in grid.regrid_bilinear(rows, META, fine).where("x between 1 and 10 and y between 1 and 10").collect():
        assert abs(r.value - (((r.x + 0.5) / 2 - 0.5) * 2 + (r.y + 0.5) / 2 - 0.5)) < 1e-9


def rings(rng, n):
    """Star shapes, some with a hole, some that touch centres and corners of cells exactly."""
    out = []
    for k in range(n):
        cx, cy, r = rng.uniform(-3, 15), rng.uniform(-3, 13), rng.uniform(0.2, 6)
        for ring, f in ((0, 1.0), (1, 0.5))[: 1 + k % 2]:
            pts = [(cx + f * r * rng.uniform(0.4, 1) * math.cos(a / 7 * math.tau), cy + f * r * rng.uniform(0.4, 1) * math.sin(a / 7 * math.tau)) for a in range(7)]
            out.append((f"r{k}", ring, ring == 1, [{"x": round(2 * x) / 2 if k % 3 == 0 else x, "y": round(2 * y) / 2 if k % 3 == 0 else y} for x, y in pts]))
    return out


def sides(rows, region):
    return [(a, b) for name, _, _, pts in rows if name == region for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]


def odd(edges, x, y):
    return sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for a, b in edges) % 2 == 1


def meets(a, b, x0, x1, y0, y1):
    """Whether an edge and a box have a point in common, by cutting the edge at the box."""
    lo, hi = 0.0, 1.0
    for p, q, low, high in ((a["x"], b["x"], x0, x1), (a["y"], b["y"], y0, y1)):
        if p == q:
            if not low <= p <= high:
                return False
        else:
            s, t = sorted(((low - p) / (q - p), (high - p) / (q - p)))
            lo, hi = max(lo, s), min(hi, t)
    return lo <= hi


@pytest.mark.parametrize("meta", [META | {"height": 11, "width": 13}, {"x0": 12.0, "y0": 10.5, "dx": -0.7, "dy": -1.3, "height": 9, "width": 17}])
def test_scan_lines_equal_every_cell_against_every_edge(spark, meta):
    rng = random.Random(7)
    rows = rings(rng, 24)
    grid_cells = [(y, x) for y in range(meta["height"]) for x in range(meta["width"]) if (y + x) % 11]
    table = spark.createDataFrame(rows, "region string, ring_id int, is_hole boolean, pts array<struct<x double, y double>>")
    df = spark.createDataFrame(grid_cells, "y int, x int")
    hx, hy = abs(meta["dx"]) / 2, abs(meta["dy"]) / 2
    inside, touched = set(), set()
    for region_ in {r[0] for r in rows}:
        edges = sides(rows, region_)
        for y, x in grid_cells:
            cx, cy = meta["x0"] + (x + 0.5) * meta["dx"], meta["y0"] + (y + 0.5) * meta["dy"]
            if odd(edges, cx, cy):
                inside.add((region_, y, x))
            if any(meets(a, b, cx - hx, cx + hx, cy - hy, cy + hy) for a, b in edges):
                touched.add((region_, y, x))
    assert {tuple(r) for r in region.rasterize_region(df, table, meta, all_touched=False).collect()} == inside and len(inside) > 100
    assert {tuple(r) for r in region.rasterize_region(df, table, meta).collect()} == inside | touched


def test_a_ring_of_very_many_vertices(spark):
    """100 000 vertices on a million cells, and points inside it: no cell and no point meets the whole ring."""
    n = 100_000
    ring = spark.range(1).select(F.lit("r").alias("region"), F.lit(0).alias("ring_id"), F.lit(False).alias("is_hole"), F.expr(f"transform(sequence(0, {n - 1}), i -> struct(500 + (400 + 60 * cos(i * 2 * pi() * 40 / {n})) * cos(i * 2 * pi() / {n}) as x, 500 + (400 + 60 * cos(i * 2 * pi() * 40 / {n})) * sin(i * 2 * pi() / {n}) as y))").alias("pts"))
    big = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "height": 1000, "width": 1000}
    all_cells = spark.range(1_000_000).select((F.col("id") / 1000).cast("int").alias("y"), (F.col("id") % 1000).cast("int").alias("x"))
    pts = ring.first().pts
    area = abs(sum(a.x * b.y - b.x * a.y for a, b in zip(pts, [*pts[1:], pts[0]], strict=True))) / 2
    began = time.perf_counter()
    n_inside = region.rasterize_region(all_cells, ring, big, all_touched=False).count()
    assert abs(n_inside - area) < 0.003 * area
    assert region.rasterize_region(all_cells, ring, big).count() > n_inside
    points = spark.range(200_000).select((F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    found = region.spatial_join_points(points, ring).count()
    assert abs(found / 200_000 - area / 1e6) < 0.01
    assert time.perf_counter() - began < 90
    held = region.slabs(region.region_edges(ring), region.outlines(region.region_edges(ring))).agg(F.sum(F.size("__edges")).alias("s"), F.avg(F.size("__edges")).alias("a")).first()
    assert held.s <= 2 * n and held.a < 20


def test_points_in_slabs_equal_every_edge(spark):
    rng = random.Random(12)
    rows = rings(rng, 30) + [("comb", 0, False, [{"x": float(k) / 4, "y": float(k % 2) * 9} for k in range(40)]), ("flat", 0, False, [{"x": 0.0, "y": 2.0}, {"x": 9.0, "y": 2.0}])]
    points = [(i, rng.randrange(-8, 40) / 2, rng.randrange(-8, 36) / 2) if i % 2 else (i, rng.uniform(-4, 20), rng.uniform(-4, 18)) for i in range(500)]
    want = sorted((i, name) for name in {r[0] for r in rows} for i, x, y in points if odd(sides(rows, name), x, y))
    table = spark.createDataFrame(rows, "region string, ring_id int, is_hole boolean, pts array<struct<x double, y double>>")
    got = region.spatial_join_points(spark.createDataFrame(points, "id int, x double, y double"), table)
    assert sorted((r.id, r.region) for r in got.collect()) == want and len(want) > 200
