"""Registered queries over arriving data: event-time windows, keyed hourly state, ingest ledger, replaced months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.functions.numeric import tie_round
from hubcast.operators.clean import lower_columns, plausible_trips
from hubcast.operators.hubs import assign_hubs
from hubcast.session import cut_lineage, shared_dir
from hubcast.sources import fixtures as fx
from hubcast.sources import io, ledger
from hubcast.sources.schemas import trip_schema
from hubcast.streaming import jobs

#: Arrivals by pickup time; every 50th trip of the first one comes with the last.
FIRST, SECOND = "1994-06-01", "1996-09-01"


def arrival(pickup: str = "trip_pickup_datetime", trip: str = "trip_id"):
    """1, 2 or 3: the arrival a trip comes with."""
    at = F.when(F.col(pickup) < F.lit(FIRST).cast("timestamp_ntz"), 1).when(F.col(pickup) < F.lit(SECOND).cast("timestamp_ntz"), 2).otherwise(3)
    return F.when((at == 1) & (F.col(trip) % 50 == 0), 3).otherwise(at)


def _land(spark: SparkSession, sf: str, src: str, number: int) -> None:
    trips = fx.raw_trips(spark, sf)
    trips.where(arrival("Trip_Pickup_DateTime") == number).write.mode("append").parquet(src)


def q_stream_closed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Three arrivals, the query stopped and resumed between them; trips later than the watermark are
    dropped, windows are emitted once they are closed, the open ones stay in the state."""
    src, out, ckpt = (shared_dir(spark, f"closed-{x}") for x in ("in", "out", "ckpt"))
    for number in (1, 2, 3):
        _land(spark, sf, src, number)
        stream = jobs.file_stream(spark, src, trip_schema(with_id=True), "parquet")
        jobs.run_to_files(jobs.closed_hub_hours(stream, "2 hours"), out, ckpt)
    return spark.read.parquet(out).select("cluster", "window_start", "rides", tie_round("fare", 6).alias("fare"))


def q_stream_hour_rates(spark, sf):
    """Hourly sums as keyed state over three arrivals (late trips included), written as they change; the newest
    version of every hour."""
    src, sink, ckpt = (shared_dir(spark, f"hours-{x}") for x in ("in", "out", "ckpt"))
    for number in (1, 2, 3):
        _land(spark, sf, src, number)
        stream = jobs.file_stream(spark, src, trip_schema(with_id=True), "parquet")
        jobs.run_updates(jobs.hour_sums(assign_hubs(plausible_trips(lower_columns(stream)))), sink, ckpt)
    columns = [*jobs.HOUR_KEYS, "rides", "passengers", "distance", "fare", "tip", "fpr", "tpm"]
    newest = jobs.latest_scores(spark, sink, columns)
    return newest.select(*[tie_round(c, 6).alias(c) if c in columns[6:] else F.col(c) for c in columns])


def _bad_lines(t: DataFrame) -> DataFrame:
    """The trips of ``t`` as CSV lines, some spoiled: a text for a number, a value too few, a value too many."""
    schema = trip_schema(with_id=True)
    cells = []
    for f in schema.fields:
        text = F.col(f.name).cast("string")
        if f.dataType.simpleString().startswith("timestamp"):
            text = F.date_format(f.name, io.TS_NTZ_FORMAT)
        cells.append(F.coalesce(text, F.lit("")))
    names = [f.name for f in schema.fields]
    fare = names.index("Fare_Amt")
    spoiled = [F.lit("n/a") if i == fare else c for i, c in enumerate(cells)]
    kind = F.col("trip_id") % 97
    return t.select(F.when(kind == 3, F.concat_ws(",", *spoiled)).when(kind == 5, F.concat_ws(",", *cells[:-1]))
                    .when(kind == 7, F.concat_ws(",", *cells, F.lit("x"))).otherwise(F.concat_ws(",", *cells)).alias("value"))


def _ingested(spark, sf) -> str:
    """Two arrivals of spoiled files, each ingested twice: the second call of a pair finds nothing to do."""
    root = shared_dir(spark, "ledger")
    for vendor in ("VTS", "CMT"):
        other = F.col("vendor_name") == vendor if vendor == "VTS" else F.col("vendor_name") != "VTS"
        _bad_lines(fx.raw_trips(spark, sf).where(other)).write.mode("append").text(f"{root}/csv")
        first, again = [ledger.ingest(spark, f"{root}/csv", f"{root}/table", trip_schema(with_id=True), "*.txt", header=False) for _ in range(2)]
        if again.number is not None or not first.files:
            raise RuntimeError(f"ingest: {first}, rerun {again}")
    return f"{root}/table"


def q_ingest_ledger(spark, sf):
    """K3: the ledger after two arrivals and their reruns: rows and bad lines of every batch, and the rows readers see."""
    table = _ingested(spark, sf)
    seen = (lower_columns(ledger.committed(spark, table, trip_schema(with_id=True))).groupBy("batch")
            .agg(F.count(F.lit(1)).alias("seen"), F.sum("trip_id").alias("trip_ids"), tie_round(F.sum("fare_amt"), 4).alias("fare")))
    return ledger.ledger(spark, table).groupBy("batch").agg(F.sum("rows").alias("n_rows"), F.sum("bad_lines").alias("bad_lines"),
                                                            (F.min("size") > 0).alias("has_size")).join(seen, "batch")


def q_ingest_quarantine(spark, sf):
    """K3: bad lines by batch and reason."""
    return ledger.quarantined(spark, _ingested(spark, sf)).groupBy("batch", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_replace_month(spark, sf):
    """One month of a monthly table replaced (fares doubled); the other months' files are untouched."""
    t = plausible_trips(fx.trips(spark, sf)).select("trip_id", "fare_amt", F.date_format("trip_pickup_datetime", "yyyy-MM").alias("month"))
    path = shared_dir(spark, "months")
    io.write_parquet(t, path, partition_by=["month"])
    files = lambda: cut_lineage(ledger.listed_files(spark, path, "*.parquet"))
    before = files()
    ledger.replace_partitions(t.where("month = '1995-03'").withColumn("fare_amt", F.col("fare_amt") * 2), path, ["month"])
    month = F.regexp_extract("path", r"month=([^/]+)/", 1)
    gone = before.join(files(), ["path", "size", "modified"], "left_anti").select(month.alias("month")).distinct()
    out = spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("rides"), tie_round(F.sum("fare_amt"), 4).alias("fare"))
    return out.join(gone.withColumn("replaced", F.lit(True)), "month", "left").fillna(False, ["replaced"])


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
