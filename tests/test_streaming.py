"""Production mode of the running hub × hour counts: watermark + append.

Arrivals are ordered in time (one file per pickup year, written in order);
with a watermark every window that is emitted is final and must equal the
batch count for that window; windows in the last arrival are not yet final
and are not emitted.
"""
from pyspark.sql import functions as F

from hubcast.operators.clean import lower_columns, plausible_trips
from hubcast.operators.hubs import assign_hubs
from hubcast.session import shared_dir
from hubcast.sources import fixtures as fx
from hubcast.sources.schemas import trip_schema
from hubcast.streaming import jobs
from tests.conftest import SF_SMALL


def test_watermarked_windows_are_final_and_exact(spark):
    raw = fx.raw_trips(spark, SF_SMALL)
    years = sorted(r[0] for r in raw.select(F.year("Trip_Pickup_DateTime").alias("y")).distinct().collect())
    src = shared_dir(spark, "wm-in")
    for y in years[:4]:
        raw.where(F.year("Trip_Pickup_DateTime") == y).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, trip_schema(with_id=True), "parquet", max_files_per_trigger=1)
    counts = jobs.hub_hour_counts(stream, watermark="1 hour")
    out, ckpt = shared_dir(spark, "wm-out"), shared_dir(spark, "wm-ckpt")
    jobs.run_to_files(counts, out, ckpt)
    emitted = spark.read.parquet(out)
    clean = assign_hubs(plausible_trips(lower_columns(raw)))
    batch = (clean.groupBy("cluster", F.date_trunc("hour", "trip_pickup_datetime").alias("window_start"))
             .agg(F.count(F.lit(1)).alias("rides_batch")))
    joined = emitted.join(batch, ["cluster", "window_start"], "left")
    n = emitted.count()
    assert n > 0
    assert joined.where(F.col("rides_batch").isNull() | (F.col("rides") != F.col("rides_batch"))).count() == 0
    last_year = years[3]
    assert emitted.where(F.year("window_start") == last_year).count() < \
        batch.where(F.year("window_start") == last_year).count()
