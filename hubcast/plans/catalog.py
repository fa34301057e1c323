"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
group.  Every query reads the driver's tables (through the fixture recipes),
so its work grows with them.  Doubles that come out of aggregation are
tie-rounded to 6 decimals for engine-independent comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubcast.functions.calendar import calendar_columns, month_label, shift_zone, to_day
from hubcast.functions.numeric import clip_negative, indicator, tie_round, typed_null
from hubcast.functions.text import (basename_sans_ext, dollar, format_bytes_gb, number_big_mark, pad2, recode,
                                    remove_all, replace_first, split_to_columns, template)
from hubcast.operators import clean, grid, hubs, joins, rollup, runlog, sampling, stats
from hubcast.plans.flagship import clean_hub_trips, hourly_hub_rates
from hubcast.session import cut_lineage
from hubcast.sources import fixtures as fx


def rounded(df: DataFrame, digits: int = 6, skip: tuple = ()) -> DataFrame:
    """Tie-round every double column (comparison form of a result)."""
    return df.select(*[tie_round(f.name, digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


def _clean(spark, sf):
    return clean.plausible_trips(fx.trips(spark, sf))


def _cal(spark, sf):
    return clean_hub_trips(fx.raw_trips(spark, sf))


def q_hourly_hub_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hourly_hub_rates(fx.raw_trips(spark, sf)))


def q_clean_trips(spark, sf):
    return clean.prepared_trips(fx.raw_trips(spark, sf))


def q_trip_calendar(spark, sf):
    t = _clean(spark, sf)
    ts = "trip_pickup_datetime"
    cal = calendar_columns(ts)
    return t.select("trip_id", *[cal[k].alias(k) for k in
                                 ["pickup_date", "pickup_year", "pickup_mon", "pickup_day", "pickup_hour",
                                  "pickup_wday", "pickup_nday"]],
                    F.hour(shift_zone(ts, "EST")).cast("int").alias("est_hour"),
                    month_label(ts).alias("month_label"),
                    to_day(ts).cast("string").alias("pickup_day_date"))


def q_dataset_summary(spark, sf):
    s = rollup.dataset_summary(fx.trips(spark, sf))
    return s.select("n", F.col("date_min").cast("string").alias("date_min"),
                    F.col("date_max").cast("string").alias("date_max"))


def q_hub_centres(spark, sf):
    return rounded(hubs.hub_centres(hubs.assign_hubs(_clean(spark, sf))))


def q_hub_profile(spark, sf):
    return rounded(hubs.hub_profile(hubs.assign_hubs(_clean(spark, sf))))


def q_hub_map_centre(spark, sf):
    return rounded(hubs.map_centre(hubs.hub_centres(hubs.assign_hubs(_clean(spark, sf)))))


def q_week_hour_heat(spark, sf):
    hourly = rollup.hourly_rollup(_cal(spark, sf))
    return rounded(rollup.week_hour_heat(hourly))


def q_week_hour_heat_raw(spark, sf):
    return rounded(rollup.week_hour_heat(_cal(spark, sf), rides=None, fare="fare_amt",
                                         distance="trip_distance"))


def q_hub_hour_complete(spark, sf):
    return rollup.hub_hour_complete(_cal(spark, sf))


def q_pickup_density(spark, sf):
    return rollup.pickup_density(_clean(spark, sf))


def q_pickup_raster(spark, sf):
    return rounded(stats.raster(_clean(spark, sf), "start_lon", "start_lat", 100))


def q_fare_histogram(spark, sf):
    return rounded(stats.histogram(_clean(spark, sf), "fare_amt", 30))


def q_fare_cells(spark, sf):
    return rounded(rollup.location_cells(_clean(spark, sf)), skip=("lon_r", "lat_r"))


def q_rides_by_passengers(spark, sf):
    return rollup.rides_by_passengers(_clean(spark, sf))


def q_distance_round(spark, sf):
    return rollup.binned_counts(_clean(spark, sf), "trip_distance", "round", 1)


def q_distance_floor(spark, sf):
    return rollup.binned_counts(_clean(spark, sf), "trip_distance", "floor")


def q_rides_by_hour(spark, sf):
    return rollup.frequency(_cal(spark, sf), "pickup_hour")


def q_payment_means(spark, sf):
    t = _clean(spark, sf).withColumn("payment_type", F.lower("payment_type"))
    return rounded(rollup.group_means(t, "payment_type", ["total_amt", "tip_amt"]))


PROFILE_COLS = ["passenger_count", "trip_distance", "fare_amt", "tip_amt", "total_amt"]


def q_fare_percentiles(spark, sf):
    return rounded(stats.percentiles(_clean(spark, sf), "fare_amt"), skip=("percentile",))


def q_trip_correlation(spark, sf):
    return rounded(stats.correlation_triangle(_clean(spark, sf), PROFILE_COLS))


def q_trip_profile(spark, sf):
    return rounded(stats.column_profile(_clean(spark, sf), PROFILE_COLS))


def q_scaled_distance(spark, sf):
    z = stats.standard_scale(_clean(spark, sf), ["trip_distance", "fare_amt"])
    return rounded(z.select("trip_id", "trip_distance_z", "fare_amt_z"))


def q_fare_on_distance(spark, sf):
    return rounded(stats.simple_regression(_clean(spark, sf), "fare_amt", "trip_distance"))


def q_url_manifest(spark, sf):
    m = grid.url_manifest(fx.trips(spark, sf))
    return m.withColumn("title", basename_sans_ext("url"))


def q_prediction_grid(spark, sf):
    return grid.hub_week_hour_grid(hubs.assign_hubs(_clean(spark, sf)))


def q_lonlat_grid(spark, sf):
    return rounded(grid.linspace_grid(_clean(spark, sf), "start_lon", "start_lat", 200))


def q_action_share(spark, sf):
    return rounded(rollup.share_table(fx.firewall(spark, sf), "Action"))


def q_action_by_protocol(spark, sf):
    return rollup.contingency(fx.firewall(spark, sf), "ApplicationProtocol", "Action", ["Denied", "Establish"])


def q_top_sources(spark, sf):
    return rollup.frequency(fx.firewall(spark, sf), "SourceIP", "DestinationIP")


def q_denied_only(spark, sf):
    fw = fx.firewall(spark, sf).withColumn("denied", indicator(F.col("Action") == "Denied"))
    return clean.where_equals(fw, "Action", "Denied").select(
        "ident", "logTime", "SourceIP", "DestinationIP", "bytessent", "denied")


LOG_COLUMNS = ["action", "runtime", "timestamp", "n_row", "filesize"]


def _logs(spark, sf):
    return runlog.union_logs([fx.runlog_a(spark, sf), fx.runlog_b(spark, sf)], columns=LOG_COLUMNS)


def q_runlog_union(spark, sf):
    return _logs(spark, sf)


def q_runlog_latest(spark, sf):
    return runlog.latest_matching(_logs(spark, sf), "action", "Model:")


def q_runlog_totals(spark, sf):
    logs = _logs(spark, sf).withColumn("run_month", F.date_format("timestamp", "yyyy-MM"))
    return rounded(runlog.runtime_totals(logs, keys=("action", "run_month")))


def q_hash_split_counts(spark, sf):
    t = _clean(spark, sf).withColumn(
        "part", sampling.modulo_split_label("trip_id", {"train": 60, "valid": 30, "test": 10}))
    return sampling.split_counts(t)


def q_wide_measures(spark, sf):
    """Four measure tables on the same keys reduced by left joins.  They are
    projections of one cached base aggregate, so the trips are scanned and
    shuffled once; the joins run over the small aggregate."""
    from pyspark import StorageLevel
    cal = _cal(spark, sf)
    keys = ["cluster", "pickup_nday", "pickup_hour"]
    base = cal.groupBy(*keys).agg(F.count(F.lit(1)).alias("rides"), F.sum("fare_amt").alias("fare"),
                                  F.sum("tip_amt").alias("tip"), F.sum("trip_distance").alias("distance")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    parts = [base.select(*keys, "rides"),
             base.select(*keys, (F.col("fare") / F.col("rides")).alias("mean_fare")),
             base.select(*keys, (F.col("tip") / F.col("rides")).alias("mean_tip")),
             base.select(*keys, (F.col("distance") / F.col("rides")).alias("mean_distance"))]
    return rounded(joins.reduce_left_join(parts, keys))


def q_first_trip_per_hub(spark, sf):
    h = hubs.assign_hubs(_clean(spark, sf)).select("cluster", "trip_id", "trip_pickup_datetime")
    return rollup.first_per_key(h, "cluster", ["trip_pickup_datetime", "trip_id"])


def q_distinct_pairs(spark, sf):
    t = _clean(spark, sf).withColumn("payment_type", F.lower("payment_type"))
    return rollup.distinct_rows(t, "payment_type", "vendor_name")


def q_weekday_rides(spark, sf):
    counts = rollup.frequency(_cal(spark, sf), "pickup_nday", sort=False)
    return grid.with_weekday(counts)


def q_trip_labels(spark, sf):
    t = _cal(spark, sf)
    key = F.concat_ws("-", "vendor_name", F.col("trip_id").cast("string"))
    pay = F.lower("payment_type")
    kp, ip = split_to_columns(key, "-", ["key_part", "id_part"])
    return t.select(
        "trip_id", pad2("pickup_hour").alias("hour_label"), key.alias("trip_key"), kp, ip,
        remove_all(pay, " |-").alias("payment_code"),
        recode(pay, {"cash": "CSH", "credit": "CRD"}).alias("payment_short"),
        dollar(tie_round("fare_amt", 2)).alias("fare_label"),
        number_big_mark("trip_id").alias("trip_number"),
        indicator(F.col("tip_amt") > 0).alias("tipped"),
        tie_round(clip_negative(F.col("tip_amt") - 1.0)).alias("tip_over_1"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}


def all_queries() -> dict:
    """Every registered query: SQL-checked operators, round trips, streams, invariants."""
    from hubcast.plans import arrivals, checks, roundtrips
    return {**QUERIES, **roundtrips.QUERIES, **checks.QUERIES, **arrivals.QUERIES}


# ------------------------------------------------------------ further operators

def q_table_counts(spark, sf):
    """Row count of every driver table used by the library, one row each."""
    names = ["lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "embeddings",
             "documents", "pages", "benchmark", "labels", "conversations"]
    parts = [rollup.row_count(fx.table(spark, sf, n)).select(F.lit(n).alias("table_name"), "n") for n in names]
    return runlog.stack_logs(parts)


def q_hub_weekday_wide(spark, sf):
    """Long → wide, rides per hub with one column per weekday."""
    long = rollup.frequency(_cal(spark, sf), "cluster", "pickup_wday", sort=False, name="rides")
    days = clean.WEEKDAYS_MON_FIRST
    return rollup.long_to_wide(long, "cluster", "pickup_wday", "rides", days).fillna(0, subset=days)


def q_hub_share_broadcast(spark, sf):
    """Counts per hub and payment type joined to the hubs' letters and shares.
    One aggregate of the trips, kept as a checkpoint, gives both sides; AQE
    broadcasts a side once it has measured it."""
    t = hubs.assign_hubs(_clean(spark, sf))
    counts = cut_lineage(t.groupBy("cluster", "payment_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_lon").alias("lon"), F.sum("start_lat").alias("lat")))
    centres = hubs.decorate_centres(counts.groupBy("cluster").agg(
        (F.sum("lon") / F.sum("n")).alias("center_lon"), (F.sum("lat") / F.sum("n")).alias("center_lat"),
        F.sum("n").alias("size")))
    return rounded(counts.select("cluster", "payment_type", "n").join(
        centres.select("cluster", "taxi_hub", "hub_pct"), "cluster", "left"))


def q_url_calendar(spark, sf):
    """Every month of the years the trips span, whether seen or not."""
    return grid.url_calendar(fx.trips(spark, sf))


def q_runlog_env_totals(spark, sf):
    """Run times by environment, memory, rows and stage."""
    return rounded(runlog.runtime_totals(fx.runlog_full(spark, sf), keys=("run_env", "run_ram", "n_row", "action")))


def q_weekday_hour_rates(spark, sf):
    """A2 + A3 without months: the table the seven-response grid is built on."""
    keys = ("cluster", "pickup_nday", "pickup_wday", "pickup_hour")
    return rounded(rollup.unit_rates(rollup.hourly_rollup(_cal(spark, sf), keys)))


def q_first_seen_rank(spark, sf):
    """Levels in order of first appearance, by keys beyond a double's precision."""
    t = fx.trips(spark, sf).select((F.col("trip_id") % 1009).alias("level"), (F.col("trip_id") + F.lit(1 << 60)).alias("seen"))
    return clean.first_appearance_rank(t, "level", "seen").select("level", F.col("level_rank").cast("long"))


def q_earliest_trip(spark, sf):
    """First row by an explicit key (top-1, no full sort)."""
    t = _clean(spark, sf).select("trip_pickup_datetime", "trip_id")
    return t.orderBy("trip_pickup_datetime", "trip_id").limit(1)


def q_runlog_stack(spark, sf):
    """Bag union of step logs by column name (no de-duplication)."""
    a = fx.runlog_a(spark, sf).withColumnRenamed("time", "runtime")
    b = fx.runlog_b(spark, sf)
    return runlog.stack_logs([a, b]).select(*LOG_COLUMNS)


def q_tipped_north(spark, sf):
    """P4 + P6 + P10: comparison filters on a result, range selection, bands."""
    t = hubs.assign_hubs(_clean(spark, sf)).where((F.col("tip_amt") > 0) & (F.col("start_lat") < 40.8))
    band = clean.case_when([(F.col("fare_amt") < 10, "low"), (F.col("fare_amt") < 30, "mid")], "high")
    sel = clean.select_columns(t.withColumn("fare_band", band), ("start_lon", "start_lat"), "cluster",
                               "fare_band", rename={"start_lon": "lon", "start_lat": "lat"})
    out = sel.groupBy("cluster", "fare_band").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("mean_lat"))
    return rounded(out.where(F.col("n") > 0))


def q_text_formats(spark, sf):
    """F3 template, F4 first-match replace, F12 byte and number formats, F13 typed null,
    P7 transmute, P9 same function over several columns."""
    t = _clean(spark, sf)
    out = clean.transmute(t, {
        "trip_id": F.col("trip_id"),
        "label": template("%s/%s", "vendor_name", F.date_format("trip_pickup_datetime", "yyyy-MM")),
        "payment_first": replace_first(F.lower("payment_type"), "a", "A"),
        "fare_gb": format_bytes_gb(F.col("fare_amt") * F.lit(1e9)),
        "fare_k": number_big_mark("trip_id"),
        "no_value": typed_null("double"),
        "log_fare": F.log(F.col("fare_amt")),
        "fare_amt": F.col("fare_amt"), "tip_amt": F.col("tip_amt"),
    })
    return rounded(out.withColumns(rollup.apply_to(["fare_amt", "tip_amt"], lambda c: F.round(c, 1))))


def q_hourly_sql_stage(spark, sf):
    """M1: the hourly rollup + rates as a SQL pipeline stage (``SQLTransformer``),
    over trips with the fixed hubs; same answer as the DataFrame flagship."""
    from hubcast.ml.pipelines import clean_statement, rollup_transformer
    from pyspark.ml.feature import SQLTransformer
    t = SQLTransformer(statement=clean_statement()).transform(fx.trips(spark, sf))
    return rounded(rollup_transformer().transform(hubs.assign_hubs(t)))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}


# ------------------------------------------------------------ selection, ranks, pyramids, many centres

def q_fare_deciles(spark, sf):
    """Exact deciles and extremes of distance and tip, both with very many equal values."""
    t = _clean(spark, sf)
    probs = tuple(i / 10 for i in range(11))
    parts = [stats.percentiles(t, c, probs).withColumn("term", F.lit(c)) for c in ("trip_distance", "tip_amt")]
    return rounded(parts[0].unionByName(parts[1]), skip=("percentile",))


_RANKED = ["passenger_count", "trip_distance", "fare_or_none"]


def _with_gaps(spark, sf):
    """Clean trips, their fare missing (null or NaN) on some."""
    fare = F.when(F.col("trip_id") % 5 == 0, F.lit(None)).when(F.col("trip_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("fare_amt"))
    return _clean(spark, sf).withColumn("fare_or_none", fare)


def q_rank_correlation(spark, sf):
    """Spearman correlations with ties and missing values, by both rules for these."""
    t = _with_gaps(spark, sf)
    return rounded(stats.correlation_matrix(t, _RANKED, "spearman", "pairwise").withColumn("rule", F.lit("pairwise"))
                   .unionByName(stats.correlation_matrix(t, _RANKED, "spearman", "listwise").withColumn("rule", F.lit("listwise"))))


def q_correlation_rules(spark, sf):
    """Pearson correlations with missing values, by both rules for these."""
    t = _with_gaps(spark, sf)
    return rounded(stats.correlation_matrix(t, _RANKED, "pearson", "pairwise").withColumn("rule", F.lit("pairwise"))
                   .unionByName(stats.correlation_matrix(t, _RANKED, "pearson", "listwise").withColumn("rule", F.lit("listwise"))))


def _raster_at(resolution: int):
    def query(spark, sf):
        pyramid = stats.raster_pyramid(_clean(spark, sf), "start_lon", "start_lat", (10, 100, 500, 1000))
        return rounded(pyramid.where(F.col("resolution") == resolution).drop("resolution"))
    query.__doc__ = f"A18: the level of {resolution} x {resolution} cells of the raster pyramid."
    return query


def many_centres(n: int = 10_000) -> list[tuple[float, float]]:
    """Centres spread over the trips' area (a rule, so that SQL can state it)."""
    return [(-74.05 + (i * 7919 % n) * (0.3 / n), 40.58 + (i * 104729 % 9973) * (0.32 / 9973)) for i in range(n)]


def q_many_hubs(spark, sf):
    """J6 with 10,000 centres: trips and the sum of their ids by nearest centre."""
    from hubcast.operators.centre_index import assign_nearest
    near = assign_nearest(_clean(spark, sf), many_centres())
    return near.groupBy("cluster").agg(F.count(F.lit(1)).alias("rides"), F.sum("trip_id").alias("trip_ids"))


QUERIES = {**{name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")},
           **{f"raster_{r}": _raster_at(r) for r in (10, 100, 500, 1000)}}
