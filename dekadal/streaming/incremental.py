"""Incremental jobs: only new dates, revised tails, calendar windows and running sums, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import calendar as cal
from ..sources.sinks import merge_cube, one_of_each, overwrite_parts, stored, upsert
from ..sources.staging import staging_dir


def incremental_update(
    stream: DataFrame, target: str, transform: Callable[[DataFrame], DataFrame], checkpoint: str, store: str,
    date: Column, partition: str = "date",
) -> StreamingQuery:
    """Process what has come since the last run, and stop.

    date says which date a row of the stream belongs to. Rows are kept in store, by date and batch; the dates that a batch
    touches are made anew by transform from all the rows that have come for them (with the partition column), and replace
    those of the target. So a date whose rows come in several batches has them all, and a batch that is run again changes
    nothing.
    """

    def put(rows: DataFrame, path: str, *parts: str) -> None:
        """Replace the partitions that the rows touch."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        put(batch.withColumns({partition: date, "__batch": F.lit(number)}), store, partition, "__batch")
        touched = batch.select(date.alias(partition)).distinct()
        own = batch.sparkSession.read.parquet(store).join(F.broadcast(touched), partition, "left_semi").drop("__batch")
        put(transform(own), target, partition)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_data_refresh(
    history: DataFrame, batch: DataFrame, n: int = 18, time: str = "date", keys: list[str] = ["series"],
) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(history with the batch's rows of its last n dekads and later, rows that came too late). Within the window a
    batch row replaces the history's row of its key and date."""
    last = history.agg(F.max(cal.dekad_index(time)).alias("__last"))
    placed = batch.crossJoin(F.broadcast(last)).withColumn("__fresh", cal.dekad_index(time) > F.coalesce(F.col("__last") - n, F.lit(-1)))
    fresh, late = placed.where("__fresh").drop("__last", "__fresh"), placed.where("not __fresh").drop("__last", "__fresh")
    kept = history.join(fresh.select(*keys, time).distinct(), [*keys, time], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), late


def refresh_stream(
    stream: DataFrame, target: str, late: str, checkpoint: str, n: int = 18, time: str = "date", keys: list[str] = ["series"],
) -> StreamingQuery:  # noqa: B006
    """Merge revisions into a stored history as they arrive. target is partitioned by time, late by batch.

    Of a batch, rows of the last n dekads that were stored before it, and later ones, replace the history's rows of their
    key and time, in the partitions of their times alone; rows that come too late go to late, in the batch's own partition.
    Of rows that a batch repeats the largest stays. Which dekads were the last is written down per batch before anything
    else, below late, so that a batch that runs again, whole or from any point, takes the same rows and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{late.rstrip('/')}-marks"
        seen = stored(spark, marks, "last long, batch long").where(F.col("batch") == number)
        if seen.isEmpty():
            ends = stored(spark, target, batch.schema).agg(F.coalesce(F.max(cal.dekad_index(time)), F.lit(-1)).cast("long").alias("last"), F.lit(number).cast("long").alias("batch"))
            overwrite_parts(ends, marks, ["batch"])
            seen = stored(spark, marks, "last long, batch long").where(F.col("batch") == number)
        last = seen.first()["last"]  # one row
        fresh = F.coalesce(cal.dekad_index(time) > (last - n if last >= 0 else -1), F.lit(False))  # a null time is late
        rows = one_of_each(batch, [*keys, time])
        upsert(rows.where(fresh), target, [*keys, time], [time])
        overwrite_parts(rows.where(~fresh).withColumn("batch", F.lit(number).cast("long")), late, ["batch"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_dekad(stream: DataFrame, time: str = "ts", value: str = "value", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Count, sum and mean per calendar dekad, a window of 8 to 11 days. Batch, or stream in update or complete mode
    (a derived key cannot be in append mode)."""
    return stream.groupBy(*keys, cal.dekad_start(time).alias("dekad")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def tumbling_dekad_stream(
    stream: DataFrame, target: str, checkpoint: str, time: str = "ts", value: str = "value", keys: list[str] = [], late: str = "30 days",
) -> StreamingQuery:  # noqa: B006
    """tumbling_dekad as a job: in update mode each batch hands on the dekads that it changed, which replace those in the
    stored target, partitioned by dekad.

    The event time of the state is the dekad's end, which is a key of the aggregation, so the state of a dekad goes once the
    watermark, late behind the newest dekad's end, has passed it: the state holds the dekads of that span, however
    many the stream has. Rows of dekads before the watermark are dropped, as in any stream with one; late_data_refresh
    and refresh_stream are the jobs that keep such rows.
    """
    ends = stream.withColumn("dekad_end", F.date_add(cal.dekad_end(time), 1).cast("timestamp")).withWatermark("dekad_end", late)
    sums = ends.groupBy(*keys, "dekad_end").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    rows = sums.select(*keys, cal.dekad_start(F.date_sub(F.to_date("dekad_end"), 1)).alias("dekad"), "n", "total", "mean")

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, target, [*keys, "dekad"], ["dekad"])

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continue_cumulative(
    batch: DataFrame, state: DataFrame | None, keys: list[str] = ["y", "x"], time: str = "date", value: str = "value",
) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(running sums of the batch continued from the state, the new state). The state is one row per key: the last sum."""
    run = F.sum(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    rows = batch.withColumn("cumulative", run)
    if state is not None:
        before = state.select(*keys, F.col("cumulative").alias("__before"))
        rows = rows.join(before, keys, "left").withColumn("cumulative", F.col("cumulative") + F.coalesce("__before", F.lit(0.0))).drop("__before")
    last = rows.groupBy(*keys).agg(F.max_by("cumulative", time).alias("cumulative"))
    if state is not None:
        last = last.unionByName(state.join(last.select(*keys), keys, "left_anti").select(*keys, "cumulative"))
    return rows, last


def cumulative_stream(
    stream: DataFrame, target: str, ends: str, checkpoint: str, keys: list[str], order: list[str], value: str = "value",
    period: Column | None = None,
) -> StreamingQuery:
    """Running sums by key as a job: target holds every row with its sum, column cumulative, partitioned by period, the dekad
    of order's first column unless another is given, which must rise with order.

    keys and order together are a row's identity: a row that comes again replaces the one before, with another value in it
    as a revision, and rows that come late take their place; in both cases the sums from there on are made anew. Of rows
    that one batch repeats the largest value stays. Null values count as nothing.

    The state is the table ends: for each period the sum of every key at its end, keys without rows there carried on. A batch
    whose first row lies in period p reads the ends of the period before p and the target from p on, and replaces exactly
    these partitions, so that a stream in order of time reads and writes its newest period alone; it depends on no
    state in memory, and a batch that runs again changes nothing. Sums are taken in a period, then carried over
    periods, so no key's whole history is one task's.
    """
    at = period if period is not None else cal.dekad_start(order[0])

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = batch.select(*keys, *order, value)
        first = own.agg(F.min(at)).first()[0]  # one row
        if first is None:
            return
        rows = one_of_each(own, [*keys, *order]).withColumn("period", at)
        double = lambda name: T.StructField(name, T.DoubleType())
        old = stored(spark, target, T.StructType([*rows.schema.fields, double("cumulative")])).where(F.col("period") >= F.lit(first)).drop("cumulative")
        merged, made = (staging_dir(spark, n) for n in ("merged", "ends"))
        # rows and ends are made once, from what is stored, before any of it is replaced
        old.join(rows.select(*keys, *order), [*keys, *order], "left_anti").unionByName(rows).write.parquet(merged)
        every = spark.read.schema(rows.schema).parquet(merged)
        before = stored(spark, ends, T.StructType([*rows.select(*keys, "period").schema.fields, double("end")])).where(F.col("period") < F.lit(first))
        newest = before.agg(F.max("period")).first()[0]  # one row, from the names of partitions
        before = (before if newest is None else before.where(F.col("period") == F.lit(newest))).select(*keys, F.col("end").alias("before"))
        totals = every.groupBy(*keys, "period").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
        periods = every.select("period").distinct()
        grid = every.select(*keys).union(before.select(*keys)).distinct().crossJoin(F.broadcast(periods))  # a few periods
        upto = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        steps = grid.join(totals, [*keys, "period"], "left").join(before, keys, "left").fillna(0.0, ["total", "before"])
        steps = steps.withColumn("end", F.col("before") + F.sum("total").over(upto)).select(*keys, "period", "end", (F.col("end") - F.col("total")).alias("start"))
        steps.write.parquet(made)
        steps = spark.read.schema(steps.schema).parquet(made)
        inner = F.sum(value).over(Window.partitionBy(*keys, "period").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        summed = every.withColumn("inner", F.coalesce(inner, F.lit(0.0))).join(steps.drop("end"), [*keys, "period"])
        overwrite_parts(summed.select(*rows.columns, (F.col("start") + F.col("inner")).alias("cumulative")), target, ["period"])
        overwrite_parts(steps.select(*keys, "period", "end"), ends, ["period"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_to_cube(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Put the cells of arriving cube files into a stored cube. Cells that come again are replaced; a date whose cells come
    in several batches has them all."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge_cube(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
