"""Structured Streaming: project arriving files (X1), score arriving trips (X2),
running hub × hour counts (X3).

Sources are file streams with an explicit schema (mandatory for streams).
Sinks are files or ``foreachBatch`` writers that run distributed writes; no
memory sink, nothing collected on the driver.  Checkpoints live below the
session's shared checkpoint folder so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubcast.operators.clean import lower_columns, plausible_trips
from hubcast.operators.hubs import FIXED_HUBS, assign_hubs
from hubcast.operators.rollup import with_calendar


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the files arriving in ``path`` (new files are picked up as they land)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        from hubcast.sources.io import ts_options
        r = ts_options(r.option("header", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def files_per_batch(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", batches: int = 8) -> int:
    """Files of a micro-batch that drains what is in ``path`` in at most ``batches`` of them (one file each, if there
    are no more files).  A batch has a fixed cost (plan, state commit, log) that follows neither rows nor state, so the
    number of batches is what must not grow with the number of files.  Files are listed, not read."""
    files = spark.read.schema(schema).format(fmt).load(path).inputFiles()
    return max(1, -(-len(files) // batches))


def run_to_files(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = True, processing_time: str | None = None):
    """Append the stream to files; ``available_now`` drains what is there and stops."""
    w = (stream.writeStream.format(fmt).outputMode("append").option("path", sink)
         .option("checkpointLocation", checkpoint))
    if fmt == "csv":
        from hubcast.sources.io import ts_options
        w = ts_options(w.option("header", True))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def project_stream(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Keep a few columns of each arriving row."""
    return stream.select(*columns)


def hub_scores(stream: DataFrame, centres=FIXED_HUBS) -> DataFrame:
    """X2 (row-level part): clean, assign hub, calendar parts of each arriving trip.
    Row-level, so it runs in append mode with no state."""
    t = plausible_trips(lower_columns(stream))
    return with_calendar(assign_hubs(t, centres)).select(
        "trip_id", "cluster", "pickup_wday", "pickup_nday", "pickup_hour", "fare_amt", "trip_distance")


def model_scores(stream: DataFrame, cluster_model: PipelineModel) -> DataFrame:
    """X2 with a fitted model: the row-level stages (SQL filter, formula, k-means)
    applied to the stream.  Each output row carries the hash of its input row
    so that results can be matched without a unique key."""
    t = lower_columns(stream)
    t = t.withColumn("_h", F.xxhash64(*[F.col(c) for c in t.columns]))
    return cluster_model.transform(t).select("_h", "cluster")


def hub_hour_counts(stream: DataFrame, ts: str = "trip_pickup_datetime", window: str = "1 hour",
                    watermark: str | None = None, centres=FIXED_HUBS) -> DataFrame:
    """Rides per hub per time window.

    Watermarks need a ``timestamp`` (not ``timestamp_ntz``); the pickup time is
    cast on this path only (session zone UTC keeps the wall clock).  With a
    watermark the state is dropped once a window can no longer change and the
    query can run in ``append`` mode; without one use ``complete`` mode.
    """
    t = plausible_trips(lower_columns(stream))
    t = assign_hubs(t, centres).withColumn("event_ts", F.col(ts).cast("timestamp"))
    if watermark:
        t = t.withWatermark("event_ts", watermark)
    return (t.groupBy("cluster", F.window("event_ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("rides"))
            .select("cluster", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rides"))


def run_complete_to_table(agg: DataFrame, table_path: str, checkpoint: str) -> None:
    """Drain a ``complete``-mode aggregation; every micro-batch overwrites the result
    table with the full current state (idempotent per epoch), written by the
    executors through ``foreachBatch``."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def closed_hub_hours(stream: DataFrame, delay: str = "2 hours", ts: str = "trip_pickup_datetime", window: str = "1 hour",
                     centres=FIXED_HUBS) -> DataFrame:
    """X3, event time: rides and fares per hub and window, each window emitted once, when it can no longer change.

    The watermark is the latest pickup time seen in earlier batches less ``delay``.
    A trip whose window ended at or before the watermark is late and dropped; a
    window at or before it is emitted (``append`` mode) and its state evicted, so
    state holds the open windows only.  State and watermark are in the query's
    checkpoint: a stopped query resumes with them.
    """
    t = plausible_trips(lower_columns(stream))
    t = assign_hubs(t, centres).withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", delay)
    return (t.groupBy("cluster", F.window("event_ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("rides"), F.sum("fare_amt").alias("fare"))
            .select("cluster", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rides", "fare"))


HOUR_KEYS = ("cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour")


def hour_sums(clustered: DataFrame) -> DataFrame:
    """Hourly sums and unit rates of trips that have a ``cluster``; on a stream the sums are keyed state,
    updated by the arriving rows alone (the rollup stage of the batch pipeline)."""
    from hubcast.ml.pipelines import rollup_transformer
    return rollup_transformer().transform(clustered)


def run_updates(agg: DataFrame, sink: str, checkpoint: str, finish=None) -> None:
    """Drain a streaming aggregate in ``update`` mode: every micro-batch writes the keys it changed, with their
    whole values, below ``epoch=<id>`` (a retried epoch replaces its own output).  ``finish`` is applied to each
    batch before it is written.  Old rows are never read again: the sums are in the state store."""
    def write(batch: DataFrame, epoch: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def score_batches(stream: DataFrame, models, sink: str, checkpoint: str) -> None:
    """X2, whole model: hours are scored when they change.

    Arriving trips are cleaned and assigned by the fitted stages, added to the
    keyed hourly sums, and the hours of the batch are scored from their sums.
    Work and writes of a batch follow its own rows; state holds one row per hub
    and hour.  ``latest_scores`` reads the newest version of every hour.
    """
    run_updates(hour_sums(models.assign(stream)), sink, checkpoint, models.predict)


def latest_scores(spark, sink: str, columns: list[str]) -> DataFrame:
    """One row per hour: ``columns`` as of the last epoch that changed it."""
    scored = spark.read.parquet(sink)
    rest = [c for c in columns if c not in HOUR_KEYS]
    newest = scored.groupBy(*HOUR_KEYS).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return newest.select(*[F.col(c) if c in HOUR_KEYS else F.col(f"_last.{c}") for c in columns])
