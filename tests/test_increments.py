"""Increments whose dates come in several batches, and tables that repeat a key."""

import datetime

from pyspark.sql import functions as F

from dekadal.operators import align
from dekadal.sources import readers, sinks
from dekadal.streaming import incremental

DAY = datetime.date(2020, 1, 1)


def arriving(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return incremental.parquet_stream(spark, path, spark.read.parquet(path).schema)


def test_a_date_in_two_batches_keeps_both(spark, tmp_path):
    path, target, store = (str(tmp_path / n) for n in ("in", "target", "store"))
    stream = arriving(spark, path, [[(DAY, 1), (DAY, 2)], [(DAY, 4), (DAY + datetime.timedelta(1), 8)], [(DAY, 16)]], "day date, v long")
    total = lambda rows: rows.groupBy("date").agg(F.sum("v").alias("v"))
    for run in range(2):  # the second run reads all files again, as after a lost checkpoint
        incremental.incremental_update(stream, target, total, str(tmp_path / f"state{run}"), store, F.col("day")).awaitTermination()
        assert sorted((r.date, r.v) for r in spark.read.parquet(target).collect()) == [(DAY, 23), (DAY + datetime.timedelta(1), 8)]


def test_cells_of_a_date_come_in_two_batches(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "cube")
    cell = lambda y, v, d=0: ("q", DAY + datetime.timedelta(d), y, 0, v)
    stream = arriving(spark, path, [[cell(0, 1.0), cell(1, 2.0)], [cell(1, 5.0), cell(2, 3.0)], [cell(0, 7.0, 1)]], "variable string, date date, y int, x int, value double")
    incremental.stream_to_cube(stream, target, str(tmp_path / "state")).awaitTermination()
    got = {(r.date.day, r.y): r.value for r in readers.read_cube(spark, target).collect()}
    assert got.keys() == {(1, 0), (1, 1), (1, 2), (2, 0)} and got[1, 0] == 1.0 and got[1, 2] == 3.0 and got[1, 1] in (2.0, 5.0)
    again = spark.createDataFrame([cell(1, 9.0)], "variable string, date date, y int, x int, value double")
    for _ in range(2):
        sinks.merge_cube(again, target)
        got = {(r.date.day, r.y): r.value for r in readers.read_cube(spark, target).collect()}
        assert len(got) == 4 and got[1, 1] == 9.0


def test_repeated_keys_of_an_index_keep_the_largest_value(spark):
    rows = lambda name, values: spark.createDataFrame([(DAY, DAY, v) for v in values], f"date_represented date, date_reported date, {name} double")
    merged = align.merge_indices({"a": rows("a", [None, 2.0, 1.0]), "b": rows("b", [None])})
    assert [tuple(r)[2:] for r in merged.collect()] == [(2.0, None)]


def test_asof_any_calendar(spark):
    at = lambda d, h=0: datetime.datetime(2020, 1, d, h)
    obs = spark.createDataFrame([(i, t) for i, t in enumerate([at(1, 5), at(3), at(3, 1), at(4), at(9), at(20), None])], "id int, ts timestamp")
    calendar = spark.createDataFrame([(datetime.date(2020, 1, d),) for d in (3, 9, 9, 12)], "date date")
    strict = {r.id: r.dekad and r.dekad.day for r in align.asof_calendar(obs, calendar).collect()}
    assert strict == {0: None, 1: None, 2: 3, 3: 3, 4: 3, 5: 12}
    upto = {r.id: r.dekad and r.dekad.day for r in align.asof_calendar(obs, calendar, strict=False).collect()}
    assert upto == {0: None, 1: 3, 2: 3, 3: 3, 4: 9, 5: 12}
    assert align.asof_calendar(obs.limit(0), calendar).count() == 0
