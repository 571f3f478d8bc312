"""A dekadal geo-time-series engine on Spark DataFrames, and operators for large corpora."""
