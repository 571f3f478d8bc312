"""What only larger tables show, on small rows: skewed points, wide counts, extracts that copy a cell's series."""

import datetime as dt
import os

import duckdb
from pyspark.sql import functions as F

from dekadal.operators import grid
from dekadal.plans import catalog
from dekadal.sources import readers, sinks

META = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "height": 4, "width": 4}
DAY = dt.date(1970, 1, 1)


def a_cube(spark, n=30):
    """Two cells with series over several spans of days, nulls among them; a third that no point meets."""
    rows = [("q", DAY + dt.timedelta(d * 400), y, x, None if d % 7 == 3 else d + 100.0 * y + 10 * x) for y, x in ((0, 0), (3, 2), (1, 1)) for d in range(n)]
    return spark.createDataFrame(rows, "variable string, date date, y int, x int, value double").coalesce(1), rows


def test_points_of_one_cell_are_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(grid, "SECTION", 4, raising=False)
    cube, cells = a_cube(spark)
    points = spark.createDataFrame([(k, f"p{k}", 0.5, 0.5) for k in range(60)] + [(99, "far", 2.5, 9.0), (99, "far", 2.5, 9.0), (98, "none", 3.5, 0.5)], "k long, name string, lon double, lat double").coalesce(1)
    got = grid.extract_point(cube, points, META)
    at = {(y, x): [(v, d, value) for v, d, yy, xx, value in cells if (yy, xx) == (y, x)] for y, x in ((0, 0), (3, 2))}
    want = [(k, d, v) for k in range(60) for _, d, v in at[0, 0]] + 2 * [(99, d, v) for _, d, v in at[3, 2]]
    assert sorted(map(repr, ((r.k, r.date, r.value) for r in got.collect()))) == sorted(map(repr, want))
    assert got.columns == ["y", "x", "k", "name", "lon", "lat", "variable", "date", "value"]
    assert got.where("k < 60").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_an_extract_of_many_points_does_not_copy_series(spark, tmp_path):
    cube, cells = a_cube(spark)
    sf, base = str(tmp_path / "sf"), spark.conf.get("spark.checkpoint.dir")
    items = [(DAY + dt.timedelta(d), s, p, float((d * 7 + s + p) % 50) + d / 3) for d in range(40) for s in range(16) for p in range(16)]
    spark.createDataFrame(items, "l_shipdate date, l_suppkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{sf}/lineitem.parquet")
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    used = []
    for n in (1000, 4000):
        spark.range(0, n, 1, 2).selectExpr("id as c_custkey", "concat('c', id) as c_name").write.mode("overwrite").parquet(f"{sf}/customer.parquet")
        before = size(base)
        rows = catalog.QUERIES["extract_to_csv"](spark, sf)
        assert rows.count() == n * 40
        used.append(size(base) - before)
    assert used[1] - used[0] < 3000 * 40  # a line of CSV for a point and none for each of its 40 dates
    points = grid.nearest_cell(spark.createDataFrame([(1, "a, b", 0.5, 0.5), (2, "c", 2.5, 9.0), (3, "d", 0.1, -4.0)], "k long, name string, lon double, lat double"), META)
    sinks.extract_points_to_csv(cube.select("y", "x", "date", "value"), points.select("k", "name", "y", "x"), str(tmp_path / "out"))
    got = readers.read_point_extract(spark, str(tmp_path / "out"), "k long, name string, y int, x int", "y int, x int, date date, value double")
    want = [(k, name, d, v) for k, name, y, x in ((1, "a, b", 0, 0), (2, "c", 3, 2), (3, "d", 0, 0)) for _, d, yy, xx, v in cells if (yy, xx) == (y, x)]
    assert sorted(map(repr, map(tuple, got.select("k", "name", "date", "value").collect()))) == sorted(map(repr, want))


def test_counts_of_six_digits_fit_their_fields(spark, tmp_path):
    spark.range(0, 100_001, 1, 4).selectExpr("id as o_orderkey", "timestamp'1997-03-05' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = catalog.QUERIES["read_sectioned_fwf"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL['read_sectioned_fwf']})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want) and got[1][4] == -100_001


def test_arriving_events_are_many_tasks_work(spark, tmp_path):
    spark.range(0, 600, 1, 4).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 30)) as ts", "concat('e', id % 2) as event_type", "double(id % 17) as value").write.parquet(f"{tmp_path}/events.parquet")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    df = catalog.QUERIES["continue_cumulative"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL['continue_cumulative']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 600
    arriving = [d for d in set(os.listdir(base)) - before if d.startswith("arriving-")]
    assert len([f for d in arriving for f in os.listdir(os.path.join(base, d)) if f.startswith("part-")]) > 5


def test_one_of_each_does_not_sort_a_single_value(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, 2.0), ("a", 1, 1.0), ("b", 2, None)], "v string, k int, w double")
    best = sinks.one_of_each(rows, ["v", "k"])
    assert sorted(map(tuple, best.collect())) == [("a", 1, 2.0), ("b", 2, None)]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
