"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from dekadal.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "asof_dekad", "align_to_spine", "missing_runs", "trend_extrapolate", "seasonal_zscore", "period_calendar", "assemble_features", "merge_indices", "flood_alert", "rescale_forecast", "grid_dekad_mean",
    "cumulative_cube", "regrid_bilinear", "zonal_mean", "spatial_join_points", "mosaic_mean", "rank_mask", "flood_change_map", "change_area", "read_altimeter", "read_climate_index", "read_sectioned_fwf",
    "file_manifest", "missing_files", "append_cube", "write_forecast", "incremental_update", "late_data_refresh", "continue_cumulative", "batch_score",
    "asof_calendar", "fit_scaler_804", "seasonal_stats", "seasonal_lookup", "seasonal_zscore_missing_keys", "rasterize_region", "rasterize_region_all_touched", "zonal_mean_all_touched", "spatial_join_places",
    "clip_to_geometry", "mask_cube", "alert_message", "patch_windows", "crop_border", "refresh_tail", "tumbling_dekad", "list_rasters", "mc_dropout_score", "latest_forecast", "ensemble_summary", "forecast_loss",
    "forecast_metrics", "join_sections",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([x + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert plain(map(tuple, got)) == plain(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
