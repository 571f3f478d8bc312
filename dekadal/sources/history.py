"""A stored table by date whose parts are replaced at once: readers see the whole of a commit or nothing of it.

Dates lie in folders of the commit that wrote them, data/commit=<id>/date=<date>, and a manifest says which commit's folder
is each date's. A commit writes new folders aside and then one manifest file, which appears whole; folders of other dates
are not touched, and readers who took an older manifest keep what it names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal

MANIFEST = "version long, date date, commit string"


def _folders(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/manifest"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, date, commit) of the newest manifest; empty where nothing is stored. A row is a date."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(_folders(path)[1])
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    return rows.where(F.col("version") == (rows.agg(F.max("version")).first()[0] or 0))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, date last. Only folders that the newest manifest names are listed, and filters on date prune them."""
    data, _ = _folders(path)
    live = manifest(spark, path).select("commit", F.col("date").cast("string")).collect()  # a row a date
    if not live:
        raise ValueError(f"nothing is stored in {path}")
    rows = spark.read.option("basePath", data).parquet(*[f"{data}/commit={c}/date={d}" for c, d in sorted(live)])
    return rows.select(*[c for c in rows.columns if c not in ("commit", "date")], F.col("date").cast("date").alias("date"))


def _commit(spark: SparkSession, path: str, rows: DataFrame, kept: DataFrame, version: int) -> None:
    data, log = _folders(path)
    commit = uuid.uuid4().hex
    folder = f"{data}/commit={commit}"
    rows.hint("rebalance", "date").write.partitionBy("date").parquet(folder)
    try:
        new = spark.read.option("basePath", folder).parquet(folder).select(F.col("date").cast("date").alias("date")).distinct()
    except AnalysisException:  # no rows
        new = spark.createDataFrame([], "date date")
    live = kept.select("date", "commit").unionByName(new.withColumn("commit", F.lit(commit)))
    live.select(F.lit(version).cast("long").alias("version"), "date", "commit").coalesce(1).write.mode("append").parquet(log)


def store_history(rows: DataFrame, path: str) -> None:
    """Store a table that has a column date, in place of all that is stored there."""
    spark = rows.sparkSession
    before = manifest(spark, path)
    _commit(spark, path, rows, before.limit(0), (before.agg(F.max("version")).first()[0] or 0) + 1)


def refresh_stored_tail(path: str, fresh: DataFrame, n: int = 18) -> None:
    """Replace the last n dekads of a stored history by the fresh rows of these dekads and later; fresh rows of older dekads are
    not taken, dates of the tail that fresh lacks go. n = 0 only adds what is later. Older dates' files are left as they are.
    The tail is that of the dekads stored when the commit begins."""
    spark = fresh.sparkSession
    before = manifest(spark, path)
    ends = before.agg(F.max(cal.dekad_index("date")), F.max("version")).first()
    last = ends[0] - n if ends[0] is not None else -1
    kept = before.where(cal.dekad_index("date") <= last)
    _commit(spark, path, fresh.where(cal.dekad_index("date") > last), kept, (ends[1] or 0) + 1)
