"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scale
from . import grid_queries, io_queries, series_queries  # noqa: F401
from .bindings import ORACLE_SQL, QUERIES, filled, query, sql


@query(sql("filled", "SELECT series, date, round((value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 4) + 0 AS value FROM filled JOIN sc USING (series)", "sc AS (SELECT series, avg(value) AS mean, stddev_pop(value) AS std FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS r FROM filled) WHERE r <= 100 GROUP BY series)"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular observations of 25 series, aligned to dekads, filled and normalised."""
    rows = filled(spark, sf_dir)
    return scale.zscore(rows, scale.fit_scaler(rows, first_n=100)).select("series", "date", (F.round("value", 4) + 0.0).alias("value"))


#: Further names of queries: in the first round these ran over whole tables beside queries that did not.
NAMES = {
    "extract_point": ["extract_point_all"], "extract_to_csv": ["extract_to_csv_all"], "alert_message": ["alert_message_all"], "append_cube": ["append_cube_whole"],
    "patch_windows": ["patch_windows_by_label"], "crop_border": ["crop_border_by_label"], "mosaic_mean": ["mosaic_mean_by_label"],
    "seasonal_stats": ["seasonal_stats_whole_year"], "seasonal_lookup": ["seasonal_lookup_whole_year"], "seasonal_zscore": ["seasonal_zscore_whole_year"],
    "batch_score": ["batch_score_36"], "supervised_windows": ["supervised_windows_6"],
}
for _name, _others in NAMES.items():
    QUERIES |= dict.fromkeys(_others, QUERIES[_name])
    ORACLE_SQL |= dict.fromkeys(_others, ORACLE_SQL[_name])

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
