"""The rules that alignment, filling, scaling and forecasts must follow, on small inline rows."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dekadal.functions import calendar as cal
from dekadal.functions import scalar
from dekadal.operators import align, features, fill, forecast, patches, scale
from dekadal.sources import readers, sinks
from dekadal.streaming import incremental

D = dt.date


def series(spark, values, start="2020-01-01", name="a"):
    spine = [r.date for r in cal.dekad_spine(spark, start, "2030-01-01").orderBy("date").limit(len(values)).collect()]
    return spark.createDataFrame([(name, d, v) for d, v in zip(spine, values, strict=True)], "series string, date date, value double")


def column(df, name="value"):
    return [r[name] for r in df.orderBy("series", "date").collect()]


def test_observation_on_a_dekads_first_day_goes_to_the_one_before(spark):
    obs = spark.createDataFrame([("a", dt.datetime(2020, 1, 11), 1.0), ("a", dt.datetime(2020, 1, 11, 6), 2.0), ("a", dt.datetime(2019, 12, 25), 3.0), ("a", dt.datetime(2025, 1, 1, 1), 4.0)], "series string, ts timestamp, value double")
    spine = cal.dekad_spine(spark, "2020-01-01", "2020-12-31")
    got = {r.value: r.dekad for r in align.asof_dekad(obs, spine).collect()}
    assert got == {1.0: D(2020, 1, 1), 2.0: D(2020, 1, 11), 3.0: None, 4.0: D(2020, 12, 21)}
    general = {r.value: r.dekad for r in align.asof_calendar(obs, spine).collect()}
    assert general == got


def test_closed_form_equals_the_search(spark):
    days = cal.daterange(spark, "2019-12-28", "2021-03-02").withColumn("ts", F.col("date").cast("timestamp"))
    spine = cal.dekad_spine(spark, "2019-12-01", "2021-12-31")
    a = {r.date: r.dekad for r in align.asof_dekad(days, spine).collect()}
    starts = sorted(r.date for r in spine.collect())
    assert a == {d: max(s for s in starts if s < d) for d in a}


def test_interpolation_by_position_and_trend_at_the_ends(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, 5.0, 6.0, 7.0, 8.0, None])
    inside = fill.interpolate_linear(df)
    assert column(inside) == [None, 1, 2, 3, 4, 5, 6, 7, 8, None]
    assert column(fill.trend_extrapolate(inside)) == pytest.approx([9, 1, 2, 3, 4, 5, 6, 7, 8, 10])
    assert column(fill.trend_extrapolate(inside, where="trailing")) == pytest.approx([None, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    few = series(spark, [1.0, 2.0, None])
    assert column(fill.trend_extrapolate(few)) == [1, 2, None]
    late = fill.trend_extrapolate(inside, as_of=F.lit("2020-03-20").cast("date"))
    assert column(late)[-1] is None


def test_missing_runs(spark):
    runs = fill.missing_runs(series(spark, [None, 1.0, None, None, 2.0, None])).orderBy("start_date").collect()
    assert [(r.length, r.kind) for r in runs] == [(1, "leading"), (2, "inside"), (1, "trailing")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=12))
def test_interpolation_equals_pandas(spark, values):
    got = column(fill.interpolate_linear(series(spark, values)))
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_area="inside")
    assert [np.nan if v is None else v for v in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_scaler_takes_the_first_rows_and_population_deviation(spark):
    df = series(spark, [1.0, 3.0, 100.0])
    stats = scale.fit_scaler(df, first_n=2).first()
    assert (stats["mean"], stats["std"]) == (2.0, 1.0)
    z = scale.zscore(df, scale.fit_scaler(df, first_n=2))
    assert column(z) == [-1, 1, 98] and column(scale.unscale(z, scale.fit_scaler(df, first_n=2))) == [1, 3, 100]
    flat = series(spark, [5.0, 5.0])
    assert column(scale.zscore(flat, scale.fit_scaler(flat))) == [0, 0]


def test_seasonal_z(spark):
    df = series(spark, [1.0, 2.0, 3.0, None])
    stats = spark.createDataFrame([("a", "01-01", 0.0, 2.0), ("a", "01-11", 5.0, 0.0)], "series string, month_day string, mean double, std double")
    assert column(scale.seasonal_zscore(df, stats)) == [0.5, 0.0, 3.0]


def test_cumulative_anomaly_uses_sample_deviation(spark):
    v = [1.0, None, 3.0, 5.0]
    got = column(scale.cumulative_anomaly(series(spark, v)), "cumulative")
    x = pd.Series(v)
    want = ((x - x.mean()) / x.std()).cumsum()
    assert got[1] is None and [got[i] for i in (0, 2, 3)] == pytest.approx([want[0], want[2], want[3]])


def test_change_classes_cover_all_patterns(spark):
    rows = spark.createDataFrame(list(itertools.product((0, 1), repeat=4)), "c int, w int, a int, b int")
    got = {(r.c, r.w, r.a, r.b): r.k for r in rows.withColumn("k", scalar.change_class(*[F.col(x) for x in "cwab"])).collect()}
    assert sum(v == "unclassified" for v in got.values()) == 8 and got[(0, 1, 1, 0)] == "likely_increase" and got[(1, 1, 1, 0)] == "possible_decrease"


def test_rank_mask_keeps_ties_and_rounds_half_to_even(spark):
    rows = [("s", 0, x, v) for x, v in enumerate([5.0, 4.0, 4.0, 1.0, None])]
    prob = spark.createDataFrame(rows, "scenario string, y int, x int, value double")
    flooded = lambda p, **k: [r.flooded for r in patches.rank_mask(prob, p, **k).orderBy("x").collect()]
    assert flooded(0.5) == [1, 1, 1, 0, 0]
    assert flooded(0.125) == [0, 0, 0, 0, 0]  # half a cell rounds to none
    assert flooded(0.375) == [1, 1, 1, 0, 0]  # one and a half cells to two, and the second is tied
    assert flooded(1.0) == [1, 1, 1, 1, 0] and flooded(0.2, denominator="all") == [1, 0, 0, 0, 0]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.floats(0, 1))
def test_rank_mask_has_at_least_n_cells(spark, values, pct):
    prob = spark.createDataFrame([("s", 0, x, float(v)) for x, v in enumerate(values)], "scenario string, y int, x int, value double")
    n = round(pct * len(values))
    got = patches.rank_mask(prob, pct).agg(F.sum("flooded")).first()[0]
    edge = sorted(values, reverse=True)[n - 1] if n else None
    assert got == (sum(v >= edge for v in values) if n else 0)


def test_mosaic_inverts_patches(spark):
    cells = [(D(2020, 1, 1), y, x, "c", float(10 * y + x)) for y in range(8) for x in range(8)]
    cube = spark.createDataFrame(cells, "date date, y int, x int, channel string, value double")
    pixels = patches.patch_pixels(patches.patch_windows(cube, 8, 8, size=4, stride=2, steps=1))
    assert pixels.count() == 9 * 16
    whole = {(r.y, r.x): r.value for r in patches.mosaic_mean(pixels, 8, 8, 4, border=0).collect()}
    assert whole == {(y, x): 10.0 * y + x for _, y, x, _, _ in cells}
    cropped = patches.mosaic_mean(pixels, 8, 8, 4, border=1)
    assert cropped.where("value is null").count() == 64 - 36


def test_bounds_accumulate_and_stop_at_zero(spark):
    rows = spark.createDataFrame([("r", h, D(2020, 1, 1), d, d - 1, d + 1, 1.0) for h, d in enumerate([1.0, -3.0, 1.0])], "run_id string, horizon int, date date, delta double, lower double, upper double, prior double")
    got = forecast.forecast_accumulate(rows).orderBy("horizon").collect()
    assert [r.delta for r in got] == [2, 0, 0] and [r.lower for r in got] == [1, 0, 0] and [r.upper for r in got] == [3, 1, 3]


def alert(spark, history, levels):
    start = [r.date for r in cal.dekad_spine(spark, "2024-01-01", "2026-12-31").orderBy("date").collect()]
    h = spark.createDataFrame([("r", d, v) for d, v in zip(start, history, strict=False)], "run_id string, date date, value double")
    f = spark.createDataFrame([("r", start[len(history) + i], v) for i, v in enumerate(levels)], "run_id string, date date, level double")
    return forecast.flood_alert(h, f).first()


def test_published_alert_figures(spark):
    fired = alert(spark, [0.2] * 5 + [0.0498043558508674] + [0.06] * 17, [0.10841958051149993, 0.1, 0.09])
    assert fired.alert and "10.8%" in fired.message and "5.9%" in fired.message and "5.0%" in fired.message
    quiet = alert(spark, [0.06] * 17 + [0.0498390550018457], [0.09769344641538477])
    assert not quiet.alert and quiet.message is None


def test_rolling_minimum_orders_by_date(spark):
    df = series(spark, [0.0065, 0.05, 0.06]).orderBy(F.desc("date"))
    assert column(features.rolling_min(df, n=2), "rolling_min") == [0.0065, 0.0065, 0.05]


def test_horizon_dates_and_due_data(spark):
    h = spark.createDataFrame([(D(2025, 12, 21),)], "date date")
    assert [r.date for r in cal.future_dekads(h, 3).orderBy("horizon").collect()] == [D(2026, 1, 1), D(2026, 1, 11), D(2026, 1, 21)]
    due = lambda d: cal.new_data_due(h, spark.createDataFrame([(d,)], "as_of date")).first().due
    assert not due(D(2026, 1, 10)) and due(D(2026, 1, 11))


def test_seasons_need_all_their_days(spark):
    runs = cal.period_calendar(cal.daterange(spark, "2023-12-01", "2024-08-30"), "seasonal").orderBy("start_date").collect()
    assert [(r.start_date, r.length) for r in runs] == [(D(2023, 12, 1), 91), (D(2024, 3, 1), 92)]
    dekads = cal.period_calendar(cal.daterange(spark, "2024-02-01", "2024-03-05"), "dekadal").orderBy("start_date").collect()
    assert [r.length for r in dekads] == [10, 10, 9]


def test_forecast_loss_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", -1.0, 1.0), ("b", 2.0, 1.0)], "run_id string, truth double, predicted double")
    got = forecast.forecast_loss(rows).first()
    mse, penalty, sums = 5 / 3, 22 / 3, (4 + 1) / 2
    assert got.loss == pytest.approx(mse * penalty + 0.1 * sums)


def test_nan_and_sentinels_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (999.99,), (1.0,)], "v double")
    assert sorted(x for (x,) in align.sentinel_to_null(df, ["v"], [999.99]).collect() if x is not None) == [1.0]


def test_refresh_and_late_rows(spark):
    history = series(spark, [float(i) for i in range(6)])
    fresh = history.withColumn("value", F.lit(-1.0))
    assert column(sinks.refresh_tail(history, fresh, n=2)) == [0, 1, 2, 3, -1, -1]
    kept, late = incremental.late_data_refresh(history, fresh.limit(6), n=2)
    assert column(kept) == [0, 1, 2, 3, -1, -1] and late.count() == 4


def test_stored_cube_replaces_dates(spark, tmp_path):
    rows = lambda v, d: spark.createDataFrame([("q", d, 0, 0, v)], "variable string, date date, y int, x int, value double")
    path = str(tmp_path / "cube")
    for v, d in ((1.0, D(2020, 1, 1)), (2.0, D(2020, 1, 11)), (3.0, D(2020, 1, 11))):
        sinks.append_cube(rows(v, d), path)
    assert sorted(r.value for r in readers.read_cube(spark, path).collect()) == [1.0, 3.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i % 28, 3), float(i)) for i in range(60)], "ts timestamp, value double")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.tumbling_dekad(incremental.parquet_stream(spark, str(tmp_path / "in"), rows.schema))
    stream.writeStream.outputMode("complete").format("memory").queryName("t").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("t").collect()) == sorted(incremental.tumbling_dekad(rows).collect())
