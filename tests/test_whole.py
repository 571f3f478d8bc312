"""Whole jobs: registered queries that leave out no customer, label, date or horizon, on small fixtures."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from dekadal.operators import patches
from dekadal.plans import catalog, io_queries
from dekadal.sources import sinks


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Customers with keys on both sides of any cut, and a few items of two years."""
    sf = str(tmp_path_factory.mktemp("sf"))
    keys = [1, 49, 50, 51, 100, 99_999, 100_000, 149_999, 163_841, 1_500_001]
    spark.createDataFrame([(k, f"c{k}") for k in keys], "c_custkey long, c_name string").write.parquet(f"{sf}/customer.parquet")
    items = [(datetime.date(1995, 1, 1) + datetime.timedelta(days=d), s, p, float((d * 7 + s * 3 + p) % 50)) for d in range(0, 800, 40) for s in range(16) for p in range(16)]
    spark.createDataFrame(items, "l_shipdate date, l_suppkey long, l_partkey long, l_quantity double").repartition(2).write.parquet(f"{sf}/lineitem.parquet")
    return sf, keys, items


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def against_sql(spark, sf, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'' if os.path.isfile(f'{sf}/{t}.parquet') else '/*.parquet'}'")
    df = catalog.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = list(map(tuple, df.collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_alerts_of_all_customers(spark, small):
    sf, keys, _ = small
    got = dict(against_sql(spark, sf, "alert_message_all", "customer"))
    assert sorted(got) == keys and "reach 9155.3%" in got[1_500_001]


@pytest.mark.parametrize("name", ["extract_point_all", "extract_to_csv_all"])
def test_all_points_are_extracted(spark, small, name):
    sf, keys, items = small
    cell = lambda a: max(0, min(15, math.floor(a)))
    want = []
    for k in keys:
        x, y = cell((18 + k % 97 * 0.125 - 20) / 0.5), cell((1 + k % 89 * 0.125 - 10) / -0.5)
        want += [(k, d, v) for d, s, p, v in items if (s, p) == (y, x)]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == sorted(want)


@needs_tables
@pytest.mark.parametrize("name", ["patch_windows_by_label", "crop_border_by_label", "mosaic_mean_by_label"])
def test_all_labels_are_patched(spark, name):
    got = against_sql(spark, SF, name, "embeddings")
    labels = spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().count()
    assert labels > 1 and len({r[0] for r in got}) == labels


def test_patches_rank_the_dates_of_each_key(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    rows = [(k, day(100 * k + d), y, x, "g", 1000.0 * k + 100 * d + 10 * y + x) for k, n in ((0, 5), (1, 3), (2, 1)) for d in range(n) for y in range(2) for x in range(2)]
    cube = spark.createDataFrame(rows, "k int, date date, y int, x int, channel string, value double")
    got = patches.patch_pixels(patches.patch_windows(cube, 2, 2, size=2, stride=2, steps=2, end_offset=1, keys=["k"]), ["k"])
    want = [(k, s, y, x, 1000.0 * k + 100 * d + 10 * y + x) for k, s, d in ((0, 0, 2), (0, 1, 3), (1, 0, 0), (1, 1, 1)) for y in range(2) for x in range(2)]
    assert sorted(map(tuple, got.select("k", "step", "y", "x", "value").collect())) == want


def test_the_whole_cube_is_stored(spark, small):
    sf, _, items = small
    stored = spark.read.parquet(io_queries.stored_cube(spark, sf))
    assert sorted(map(tuple, stored.select("date", "y", "x", "value").collect())) == sorted(items)
    assert all(len(os.listdir(f)) <= 2 for f in {os.path.dirname(p.removeprefix("file://")) for p in stored.inputFiles()})  # a file and its checksum


def test_the_whole_cube_is_appended_to(spark, small):
    got = against_sql(spark, small[0], "append_cube_whole", "lineitem")
    assert len(got) == len(small[2]) and {r[0] for r in got if r[3] == -1} == {max(i[0] for i in small[2])}


@needs_tables
@pytest.mark.parametrize("name", ["seasonal_stats_whole_year", "seasonal_lookup_whole_year", "seasonal_zscore_whole_year"])
def test_february_has_statistics(spark, name):
    got = against_sql(spark, SF, name, "orders", "customer", "nation")
    if name == "seasonal_stats_whole_year":
        assert {r[1] for r in got} >= {"02-01", "02-11", "02-21"}


def test_the_reader_prunes_the_whole_cube(spark, small):
    assert against_sql(spark, small[0], "read_cube", "lineitem")


@needs_tables
@pytest.mark.parametrize("name", ["batch_score_36", "supervised_windows_6"])
def test_whole_windows(spark, name):
    assert against_sql(spark, SF, name, "orders", "customer", "nation")


@needs_tables
@pytest.mark.parametrize("name", ["mc_dropout_bounds", "rf_forecast_bounds", "supervised_windows", "batch_score"])
def test_models_and_their_windows(spark, name):
    assert against_sql(spark, SF, name, "orders", "customer", "nation")


@needs_tables
@pytest.mark.parametrize("name", ["write_forecast", "latest_forecast", "extract_point", "extract_to_csv", "append_cube", "stream_to_cube"])
def test_all_items_count(spark, name):
    assert against_sql(spark, SF, name, "lineitem", "customer")


@needs_tables
@pytest.mark.parametrize("name", ["mc_dropout_score", "rf_forecast"])
def test_six_horizons_per_series(spark, name):
    got = catalog.QUERIES[name](spark, SF).groupBy("series").agg({"horizon": "collect_set"}).collect()
    assert len(got) == 25 and all(sorted(r[1]) == list(range(6)) for r in got)


def test_alerts_are_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).selectExpr("id % 2 = 0 as alert", "concat('alert ', id) as message")
    sinks.write_alert(rows, str(tmp_path / "alert"))
    assert len(list((tmp_path / "alert").glob("part-*"))) == 4
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "alert")).collect()) == sorted(f"alert {i}" for i in range(0, 100, 2))
