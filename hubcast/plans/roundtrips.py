"""Source/sink queries: write a table derived from the driver's data into the
shared scratch folder, read it back through the operator under test, and
return the read-back (its oracle is the source table itself)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubcast.operators.clean import lower_columns, plausible_trips
from hubcast.operators.rollup import distinct_rows
from hubcast.session import cut_lineage, shared_dir
from hubcast.sources import fixtures as fx
from hubcast.sources import io
from hubcast.sources.schemas import RUNLOG_SCHEMA, trip_schema

#: The trips in two files' worth: one vendor, and all others (none is lost, whatever vendors there are).
VENDORS = {"VTS": "vendor_name <=> 'VTS'", "others": "NOT vendor_name <=> 'VTS'"}

#: Trips in a compressed CSV file, some 3 MB: a file is read by one task, a task reads many.
TRIPS_PER_FILE = 50_000

CANONICAL = {f.name.lower(): f.dataType.simpleString() for f in trip_schema(with_id=True).fields}


def _canonical(df: DataFrame) -> DataFrame:
    d = lower_columns(df)
    return d.select(*[F.col(c).cast(CANONICAL[c]).alias(c) for c in CANONICAL if c in d.columns])


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + K2: CSV with header written, read back with the fixed schema."""
    path = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "trips-csv"))
    return lower_columns(io.read_csv(spark, path, schema=trip_schema(with_id=True)))


def q_csv_inferred(spark, sf):
    """The same files read with schema inference."""
    path = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "trips-csv-infer"))
    return _canonical(io.read_csv(spark, path, infer=True))


def q_csv_strings(spark, sf):
    """S3 + S5: every column read as a string, typed on demand with ``try_cast``,
    repartitioned on read."""
    path = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "trips-csv-str"),
                        compressed=True, rows_per_file=TRIPS_PER_FILE)
    raw = lower_columns(io.read_csv(spark, path, repartition=4))
    return io.typed(raw, CANONICAL).select(*CANONICAL)


def q_parquet_append(spark, sf):
    """K1 + U3: two appends into one dataset partitioned by vendor, read back whole."""
    trips = fx.raw_trips(spark, sf)
    path = shared_dir(spark, "trips-parquet")
    for those in VENDORS.values():
        io.write_parquet(trips.where(those), path, mode="append",
                         partition_by=["vendor_name"])
    return lower_columns(io.read_parquet(spark, path))


def q_json_roundtrip(spark, sf):
    """JSON lines written, read back with the schema."""
    t = plausible_trips(fx.trips(spark, sf))
    path = io.write_json(t, shared_dir(spark, "trips-json"))
    return io.read_json(spark, path, t.schema)


def q_orc_roundtrip(spark, sf):
    """ORC written and read back."""
    t = plausible_trips(fx.trips(spark, sf))
    return spark.read.orc(io.write_orc(t, shared_dir(spark, "trips-orc")))


def q_csv_combine(spark, sf):
    """Two CSV outputs with different columns stacked by name."""
    t = fx.trips(spark, sf)
    a = io.write_csv(t.where(VENDORS["VTS"]).select("trip_id", "vendor_name", "fare_amt"),
                     shared_dir(spark, "combine-a"))
    b = io.write_csv(t.where(VENDORS["others"]).select("trip_id", "vendor_name", "tip_amt"),
                     shared_dir(spark, "combine-b"))
    out = io.combine_csv(spark, [a, b])
    return out.select(F.col("trip_id").cast("long"), "vendor_name",
                      F.col("fare_amt").cast("double"), F.col("tip_amt").cast("double"))


def q_file_manifest(spark, sf):
    """Manifest of the files written by a CSV conversion (layout-dependent: rows only)."""
    path = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "manifest"))
    return io.file_manifest(spark, path, "csv", "overwrite", out_root=path + "-parquet")


def q_ingest_one_job(spark, sf):
    """K3 (single job): every source file in one scan, output partitioned by
    source file; the converted rows read back."""
    from hubcast.sources.schemas import trip_schema
    trips = fx.raw_trips(spark, sf)
    root = shared_dir(spark, "ingest1")
    srcs = [io.write_csv(trips.where(those), f"{root}/csv/{name}") for name, those in VENDORS.items()]
    target = f"{root}/parquet"
    io.ingest_one_job(spark, srcs, target, trip_schema(with_id=True), partition_by_file=True)
    return lower_columns(io.read_parquet(spark, target).drop("source_file"))


def firewall_file(spark, sf) -> str:
    """The firewall log as CSV in file order: flags as text in mixed spellings, absent columns empty."""
    from hubcast.sources.schemas import firewall_schema
    fw = fx.firewall(spark, sf).withColumns({
        "Payload": F.when(F.col("Action") == "Denied", F.lit("true")).otherwise(F.lit("false")),
        "IPHeader": F.when(F.col("ident") % 2 == 0, F.lit("YES")).otherwise(F.lit("no"))})
    full = fw.select(*[F.col(f.name) if f.name in fw.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in firewall_schema().fields])
    return io.write_csv(full, shared_dir(spark, "firewall-csv"))


def q_firewall_csv_typed(spark, sf):
    """S3 on the fixed firewall schema: read back in file order (the header is
    checked), every flag as a string, typed on demand with ``try_cast``."""
    from hubcast.sources.schemas import FIREWALL_FLAGS, firewall_schema
    raw = io.read_csv(spark, firewall_file(spark, sf), schema=firewall_schema(), check_header=True)
    empty = [f for f in FIREWALL_FLAGS if f not in ("Payload", "IPHeader")]
    typed = io.typed(raw, {f: "boolean" for f in FIREWALL_FLAGS})
    return typed.select(
        "ident", "logTime", "servername", "SourceIP", "DestinationIP", "Action", "rule", "ApplicationProtocol",
        "bytessent", "bytesrecvd", "Payload", "IPHeader", F.coalesce(*empty).isNull().alias("rest_empty"))


def q_checkpoint_roundtrip(spark, sf):
    """K6: reliable checkpoint into the shared folder cuts the lineage; same rows."""
    t = plausible_trips(fx.trips(spark, sf)).select("trip_id", "vendor_name", "fare_amt")
    return cut_lineage(t)


def q_persisted_distinct(spark, sf):
    """K5 + A24: cached, registered table queried by name."""
    columns = ["vendor_name", "passenger_count"]
    cached = io.persist_as(plausible_trips(fx.trips(spark, sf)).select(*columns), "trips_clean")
    out = cut_lineage(distinct_rows(spark.table("trips_clean"), *columns))
    cached.unpersist()
    return out


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}


def q_ingest_loop(spark, sf):
    """K3 + U3: per-file CSV → Parquet conversion appending into one dataset; a
    missing file is recorded as a failure and the other files still load."""
    from hubcast.sources.schemas import trip_schema
    trips = fx.raw_trips(spark, sf)
    root = shared_dir(spark, "ingest")
    sources = []
    for name, those in VENDORS.items():
        sources.append(io.write_csv(trips.where(those), f"{root}/csv/{name}"))
    sources.insert(1, f"{root}/csv/missing-file")
    target = f"{root}/parquet"
    results = io.ingest_files(spark, sources, lambda src: target, trip_schema(with_id=True), mode="append")
    failed = [r.source for r in results if not r.ok]
    if failed != [sources[1]]:
        raise RuntimeError(f"ingest loop: unexpected failures {failed}")
    return lower_columns(io.read_parquet(spark, target))


def _bundle(spark, sf) -> dict[str, str]:
    from hubcast.operators.hubs import assign_hubs
    from hubcast.plans.summaries import summaries_one_pass, write_bundle
    raw = fx.raw_trips(spark, sf)
    clustered = assign_hubs(plausible_trips(lower_columns(raw)))
    tables = summaries_one_pass(raw, clustered, density_cap=10_000)
    return write_bundle(tables, shared_dir(spark, "bundle"), run_date="2020-02-26")


def q_summary_bundle(spark, sf):
    """K8: the summaries written as one dated bundle; the heat table read back."""
    from hubcast.plans.catalog import rounded
    return rounded(spark.read.parquet(_bundle(spark, sf)["s_heatmap"]))


def q_bundle_density(spark, sf):
    """The published density table of the bundle, every cell of it."""
    return spark.read.parquet(_bundle(spark, sf)["s_blackmap"])


def q_runlog_steps(spark, sf):
    """K9: timed steps written to a run log and read back: what ran, on how many rows, in order."""
    from hubcast.operators.runlog import RunLog
    log = RunLog(run_env="query", run_ram="default")
    for name in ("lineitem", "events", "embeddings"):
        with log.step(f"Count: {name}") as step:
            step["n_row"] = fx.table(spark, sf, name).count()
    path = shared_dir(spark, "steps")
    log.append_to(spark, path)
    return io.read_csv(spark, path, schema=RUNLOG_SCHEMA).select("action", "run_env", F.col("n_row").cast("long").alias("n_row"), (F.col("runtime") >= 0).alias("timed"))


def q_payment_names(spark, sf):
    """A literal lookup table joined to the trips' payment types."""
    names = io.local_table(spark, [("Cash", "cash", True), ("CREDIT", "card", True), ("Dispute", "disputed", False)],
                           "payment_type string, payment string, paid boolean")
    return (plausible_trips(fx.trips(spark, sf)).join(F.broadcast(names), "payment_type", "left")
            .groupBy("payment", "paid").agg(F.count(F.lit(1)).alias("rides")))


# ---------------------------------------------------------------- streams

def _stream_input(spark: SparkSession, sf: str, fmt: str) -> tuple[str, object]:
    """Write the raw trips as three arrivals (by order key) into a fresh folder."""
    from hubcast.sources.schemas import trip_schema
    trips = fx.raw_trips(spark, sf)
    src = shared_dir(spark, f"stream-in-{fmt}")
    for part in range(3):
        chunk = trips.where(F.pmod(F.floor(F.col("trip_id") / 8), F.lit(3)) == part)
        io.ts_options(chunk.write.mode("append").format(fmt).option("header", True)).save(src)
    return src, trip_schema(with_id=True)


def q_stream_project(spark, sf):
    """CSV files streamed in, three columns projected, CSV files out."""
    from hubcast.streaming import jobs
    src, schema = _stream_input(spark, sf, "csv")
    out, ckpt = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt")
    cols = ["trip_id", "Trip_Pickup_DateTime", "Fare_Amt"]
    jobs.run_to_files(jobs.project_stream(jobs.file_stream(spark, src, schema, "csv", 8), cols),
                      out, ckpt, fmt="csv")
    sub = T.StructType([schema[c] for c in cols])
    return lower_columns(io.read_csv(spark, out, schema=sub))


def q_stream_hub_scores(spark, sf):
    """Arriving trips cleaned, assigned to hubs, calendar parts added."""
    from hubcast.streaming import jobs
    src, schema = _stream_input(spark, sf, "parquet")
    out, ckpt = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt")
    jobs.run_to_files(jobs.hub_scores(jobs.file_stream(spark, src, schema, "parquet", 8)), out, ckpt)
    return spark.read.parquet(out)


def q_stream_hub_hours(spark, sf):
    """Running rides per hub and hour; final state equals the batch answer."""
    from hubcast.streaming import jobs
    src, schema = _stream_input(spark, sf, "parquet")
    table, ckpt = shared_dir(spark, "stream-table"), shared_dir(spark, "stream-ckpt")
    jobs.run_complete_to_table(jobs.hub_hour_counts(jobs.file_stream(spark, src, schema, "parquet", 8)),
                               table, ckpt)
    return spark.read.parquet(table)


def q_stream_model_check(spark, sf):
    """X2 with the fitted clustering: stream assignments equal batch assignments."""
    from hubcast.ml.pipelines import cluster_pipeline
    from hubcast.streaming import jobs
    trips = fx.trips(spark, sf)
    model = cluster_pipeline().fit(trips)
    src, schema = _stream_input(spark, sf, "parquet")
    out, ckpt = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt")
    jobs.run_to_files(jobs.model_scores(jobs.file_stream(spark, src, schema, "parquet", 8), model), out, ckpt)
    from hubcast.plans.checks import multiset_mismatches, row_hash
    streamed = spark.read.parquet(out)
    batch = model.transform(trips).select(row_hash(trips).alias("_h"), "cluster")
    diff = multiset_mismatches(batch, streamed, ["_h", "cluster"])
    return spark.range(1).select(diff.alias("mismatches"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
