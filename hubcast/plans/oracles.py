"""Equivalent DuckDB SQL for the registered queries (the correctness oracle).

Each statement re-derives the fixture tables with the same expressions as
``hubcast.sources.fixtures`` and computes the answer independently of Spark.
Doubles that come from aggregation are compared after ``round(x * (1 + 1e-12), 6)``
on both sides.
"""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) * 1.000000000001E0, {digits})"


_M = "((l_orderkey * 37 + l_partkey * 5) % 1440)"

TRIPS = f"""trips AS (
  SELECT l_orderkey * 8 + l_linenumber AS trip_id,
         CASE WHEN l_linestatus = 'O' THEN 'VTS' ELSE 'CMT' END AS vendor_name,
         l_shipdate + to_minutes({_M}) AS trip_pickup_datetime,
         l_shipdate + to_minutes({_M} + CAST(l_quantity AS INTEGER)) AS trip_dropoff_datetime,
         CAST(l_suppkey % 8 AS DOUBLE) AS passenger_count,
         (l_quantity - 1) * 2.1E0 AS trip_distance,
         -74.06E0 + (l_partkey % 320) * 0.001E0 AS start_lon,
         40.57E0 + ((l_orderkey * 7 + l_partkey * 3) % 340) * 0.001E0 AS start_lat,
         '1' AS rate_code, '0' AS store_and_forward,
         -74.06E0 + ((l_partkey * 13 + l_suppkey) % 320) * 0.001E0 AS end_lon,
         40.57E0 + ((l_orderkey * 11 + l_linenumber) % 340) * 0.001E0 AS end_lat,
         CASE l_returnflag WHEN 'A' THEN 'Cash' WHEN 'N' THEN 'CREDIT' ELSE 'No Charge' END AS payment_type,
         l_extendedprice / 1000 AS fare_amt, 0.5E0 AS surcharge, '0.5' AS mta_tax,
         l_extendedprice / 1000 * l_discount AS tip_amt, 0.0E0 AS tolls_amt,
         l_extendedprice / 1000 * (1 + l_tax) - 2 AS total_amt
  FROM lineitem)"""

CLEAN_WHERE = """start_lon > -74.05E0 AND start_lon < -73.75E0 AND start_lat > 40.58E0 AND start_lat < 40.9E0
  AND end_lon > -74.05E0 AND end_lon < -73.75E0 AND end_lat > 40.58E0 AND end_lat < 40.9E0
  AND passenger_count > 0.0E0 AND passenger_count < 7.0E0 AND trip_distance > 0.0E0 AND trip_distance < 100.0E0
  AND total_amt > 0.0E0 AND trip_pickup_datetime IS NOT NULL"""

CLEAN = f"clean AS (SELECT * FROM trips WHERE {CLEAN_WHERE})"

HUBS = [(-74.00, 40.65), (-73.98, 40.75), (-73.87, 40.77), (-73.95, 40.84), (-73.80, 40.64)]


def _d(i: int) -> str:
    x, y = HUBS[i]
    return (f"((start_lon - ({x!r}E0)) * (start_lon - ({x!r}E0)) + "
            f"(start_lat - ({y!r}E0)) * (start_lat - ({y!r}E0)))").replace("E0E0", "E0")


_ALL = ", ".join(f"d{i}" for i in range(len(HUBS)))
HUB = ("dist AS (SELECT *, " + ", ".join(f"{_d(i)} AS d{i}" for i in range(len(HUBS))) + " FROM clean), "
       "hub AS (SELECT * EXCLUDE (" + _ALL + "), CASE "
       + " ".join(f"WHEN d{i} = least({_ALL}) THEN {i}" for i in range(len(HUBS)))
       + " END AS cluster FROM dist)")

CAL = """cal AS (SELECT *, strftime(trip_pickup_datetime, '%Y') AS pickup_year,
  strftime(trip_pickup_datetime, '%m') AS pickup_mon, strftime(trip_pickup_datetime, '%a') AS pickup_wday,
  CAST(dayofweek(trip_pickup_datetime) + 1 AS INTEGER) AS pickup_nday,
  CAST(hour(trip_pickup_datetime) AS INTEGER) AS pickup_hour FROM hub)"""

WITH_HUB = f"WITH {TRIPS}, {CLEAN}, {HUB}"
WITH_CAL = f"WITH {TRIPS}, {CLEAN}, {HUB}, {CAL}"

HOURLY = """hourly AS (SELECT cluster, pickup_year, pickup_mon, pickup_wday, pickup_nday, pickup_hour,
  count(*) AS rides, sum(passenger_count) AS passengers, sum(trip_distance) AS distance,
  sum(fare_amt) AS fare, sum(tip_amt) AS tip FROM cal GROUP BY ALL)"""

PASTEL1 = ["#FBB4AE", "#B3CDE3", "#CCEBC5", "#DECBE4", "#FED9A6",
           "#FFFFCC", "#E5D8BD", "#FDDAEC", "#F2F2F2"]

FIREWALL = """firewall AS (SELECT CAST(event_id AS DOUBLE) AS ident, ts AS logTime,
  concat('10.0.0.', CAST(user_id % 16 AS VARCHAR)) AS SourceIP,
  concat('192.168.1.', CAST(event_id % 8 AS VARCHAR)) AS DestinationIP,
  concat('10.1.0.', CAST(user_id % 5 AS VARCHAR)) AS OriginalClientIP,
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Denied' ELSE 'Establish' END AS Action,
  CASE WHEN event_type = 'error' THEN '0x80074e20' ELSE '0x0' END AS resultcode,
  concat('rule-', CAST((user_id + event_id) % 4 AS VARCHAR)) AS rule,
  CASE event_id % 3 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'HTTPS' ELSE 'DNS' END AS ApplicationProtocol,
  value AS bytessent, value * 2 AS bytesrecvd FROM events)"""

RUNLOGS = """log_a AS (SELECT CASE event_type WHEN 'view' THEN 'Model: Fit' WHEN 'signup' THEN 'Model: Load' ELSE 'Load: file' END AS action, value AS runtime, CAST(user_id AS DOUBLE) AS n_row,
    ts AS "timestamp", CAST(NULL AS DOUBLE) AS filesize FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'purchase')),
  log_b AS (SELECT CASE event_type WHEN 'click' THEN 'Write: file' ELSE 'Write: model' END AS action, value AS runtime, CAST(NULL AS DOUBLE) AS n_row, ts AS "timestamp",
    CAST(event_id AS DOUBLE) AS filesize FROM events WHERE event_type IN ('click', 'purchase')),
  logs AS (SELECT DISTINCT * FROM (SELECT * FROM log_a UNION ALL SELECT * FROM log_b))"""


def _bins(x: str, lo: str, hi: str, bins: int) -> str:
    w = f"(({hi}) - ({lo})) / {float(bins)!r}E0".replace("E0E0", "E0")
    return f"CAST(least(coalesce(floor((({x}) - ({lo})) / nullif({w}, 0)), 0), {bins - 1}) AS INTEGER)"


def _edge(idx: str, lo: str, hi: str, bins: int) -> str:
    return f"(({hi}) - ({lo})) / {float(bins)!r}E0 * {idx} + ({lo})".replace("E0E0", "E0")


PROFILE_COLS = ["passenger_count", "trip_distance", "fare_amt", "tip_amt", "total_amt"]


def _profile_sql() -> str:
    parts = []
    for c in PROFILE_COLS:
        parts.append(f"SELECT '{c}' AS summary, count({c}) AS count, {R(f'avg({c})')} AS mean, "
                     f"{R(f'stddev_samp({c})')} AS stddev, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max FROM clean")
    return f"WITH {TRIPS}, {CLEAN} " + " UNION ALL ".join(parts)


def _corr_sql() -> str:
    parts = []
    cols = PROFILE_COLS
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            parts.append(f"SELECT '{cols[j]}' AS term_x, '{cols[i]}' AS term_y, "
                         f"{R(f'corr({cols[j]}, {cols[i]})')} AS corr FROM clean")
    return f"WITH {TRIPS}, {CLEAN} " + " UNION ALL ".join(parts)


def _percentile_sql() -> str:
    parts = [f"SELECT {p}E0 AS percentile, {R(f'quantile_cont(fare_amt, {p})')} AS value FROM clean"
             for p in (0.25, 0.5, 0.75)]
    return f"WITH {TRIPS}, {CLEAN} " + " UNION ALL ".join(parts)


def _heat_sql(from_hourly: bool) -> str:
    if from_hourly:
        src = (f"{WITH_CAL}, {HOURLY}, agg AS (SELECT pickup_wday, pickup_hour, sum(rides) AS rides, "
               "sum(fare) / sum(distance) AS fpm FROM hourly GROUP BY ALL)")
    else:
        src = (f"{WITH_CAL}, agg AS (SELECT pickup_wday, pickup_hour, count(*) AS rides, "
               "sum(fare_amt) / sum(trip_distance) AS fpm FROM cal GROUP BY ALL)")
    days = ", ".join(f"'{d}'" for d in ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])
    return (src + ", grid AS (SELECT w.pickup_wday, h.pickup_hour FROM (SELECT DISTINCT pickup_wday FROM agg) w, "
            "(SELECT DISTINCT pickup_hour FROM agg) h) "
            "SELECT g.pickup_wday, lpad(CAST(g.pickup_hour AS VARCHAR), 2, '0') AS pickup_hour, "
            f"CAST(coalesce(a.rides, 0) AS BIGINT) AS rides, {R('coalesce(a.fpm, 0)')} AS fpm, "
            f"CAST(list_position([{days}], g.pickup_wday) AS INTEGER) AS wday_rank "
            "FROM grid g LEFT JOIN agg a ON g.pickup_wday = a.pickup_wday AND g.pickup_hour = a.pickup_hour")


def _centres_body() -> str:
    pal = ", ".join(f"'{c}'" for c in PASTEL1)
    return (f"agg AS (SELECT cluster, avg(start_lon) AS center_lon, avg(start_lat) AS center_lat, "
            f"count(*) AS size FROM hub GROUP BY cluster), "
            f"ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster) AS rk, "
            f"sum(size) OVER () AS tot FROM agg), "
            f"centres AS (SELECT cluster, center_lon, center_lat, size, chr(CAST(64 + rk AS INTEGER)) AS taxi_hub, "
            f"[{pal}][rk] AS hub_color, size / tot AS hub_pct FROM ranked)")


def _centres_select(prefix: str = "c.") -> str:
    return (f"{prefix}cluster, {R(prefix + 'center_lon')} AS center_lon, {R(prefix + 'center_lat')} AS center_lat, "
            f"{prefix}size, {prefix}taxi_hub, {prefix}hub_color, {R(prefix + 'hub_pct')} AS hub_pct")


def _raster_sql() -> str:
    lo_x, hi_x = "(SELECT min(start_lon) FROM clean)", "(SELECT max(start_lon) FROM clean)"
    lo_y, hi_y = "(SELECT min(start_lat) FROM clean)", "(SELECT max(start_lat) FROM clean)"
    return (f"WITH {TRIPS}, {CLEAN}, b AS (SELECT {_bins('start_lon', lo_x, hi_x, 100)} AS x_bin, "
            f"{_bins('start_lat', lo_y, hi_y, 100)} AS y_bin, count(*) AS n FROM clean GROUP BY ALL) "
            f"SELECT x_bin, y_bin, n, {R(_edge('x_bin', lo_x, hi_x, 100))} AS start_lon, "
            f"{R(_edge('y_bin', lo_y, hi_y, 100))} AS start_lat FROM b")


def _hist_sql() -> str:
    lo, hi = "(SELECT min(fare_amt) FROM clean)", "(SELECT max(fare_amt) FROM clean)"
    return (f"WITH {TRIPS}, {CLEAN}, b AS (SELECT {_bins('fare_amt', lo, hi, 30)} AS bin, count(*) AS n "
            f"FROM clean WHERE fare_amt IS NOT NULL GROUP BY ALL) "
            f"SELECT bin, n, {R(_edge('bin', lo, hi, 30))} AS fare_amt FROM b")


def _lonlat_sql() -> str:
    lo_x, hi_x = "(SELECT min(start_lon) FROM clean)", "(SELECT max(start_lon) FROM clean)"
    lo_y, hi_y = "(SELECT min(start_lat) FROM clean)", "(SELECT max(start_lat) FROM clean)"
    return (f"WITH {TRIPS}, {CLEAN}, ids AS (SELECT range AS id FROM range(40000)) "
            f"SELECT {R(f'{lo_x} + (id // 200) * (({hi_x} - {lo_x}) / 199)')} AS start_lon, "
            f"{R(f'{lo_y} + (id % 200) * (({hi_y} - {lo_y}) / 199)')} AS start_lat FROM ids")


def _scaled_sql() -> str:
    return (f"WITH {TRIPS}, {CLEAN} SELECT trip_id, "
            f"{R('(trip_distance - (SELECT avg(trip_distance) FROM clean)) / (SELECT stddev_samp(trip_distance) FROM clean)')} AS trip_distance_z, "
            f"{R('(fare_amt - (SELECT avg(fare_amt) FROM clean)) / (SELECT stddev_samp(fare_amt) FROM clean)')} AS fare_amt_z "
            "FROM clean")


def _contingency_sql() -> str:
    return (f"WITH {FIREWALL} SELECT ApplicationProtocol, "
            "count(*) FILTER (WHERE Action = 'Denied') AS Denied, "
            "count(*) FILTER (WHERE Action = 'Establish') AS Establish, "
            "count(*) FILTER (WHERE Action IS NULL OR Action NOT IN ('Denied', 'Establish')) AS other FROM firewall GROUP BY ALL")


SPLIT = "CASE WHEN (trip_id % 1000003) * 7919 % 100 < 60 THEN 'train' WHEN (trip_id % 1000003) * 7919 % 100 < 90 THEN 'valid' ELSE 'test' END"

ORACLES: dict[str, str] = {
    "hourly_hub_rates": f"{WITH_CAL}, {HOURLY} SELECT cluster, pickup_year, pickup_mon, pickup_wday, pickup_nday, "
                        f"pickup_hour, rides, {R('passengers')} AS passengers, {R('distance')} AS distance, "
                        f"{R('fare')} AS fare, {R('tip')} AS tip, {R('passengers / rides')} AS ppr, "
                        f"{R('distance / rides')} AS dpr, {R('fare / rides')} AS fpr, {R('tip / rides')} AS tpr, "
                        f"{R('fare / distance')} AS fpm, {R('tip / distance')} AS tpm FROM hourly",
    "clean_trips": f"WITH {TRIPS}, {CLEAN} SELECT * REPLACE (lower(payment_type) AS payment_type), "
                   "CAST(epoch(trip_dropoff_datetime) - epoch(trip_pickup_datetime) AS BIGINT) AS trip_time FROM clean",
    "trip_calendar": f"WITH {TRIPS}, {CLEAN} SELECT trip_id, strftime(trip_pickup_datetime, '%Y-%m-%d') AS pickup_date, "
                     "strftime(trip_pickup_datetime, '%Y') AS pickup_year, strftime(trip_pickup_datetime, '%m') AS pickup_mon, "
                     "strftime(trip_pickup_datetime, '%d') AS pickup_day, CAST(hour(trip_pickup_datetime) AS INTEGER) AS pickup_hour, "
                     "strftime(trip_pickup_datetime, '%a') AS pickup_wday, CAST(dayofweek(trip_pickup_datetime) + 1 AS INTEGER) AS pickup_nday, "
                     "CAST(hour(trip_pickup_datetime + INTERVAL 5 HOUR) AS INTEGER) AS est_hour, "
                     "strftime(trip_pickup_datetime, '%b %Y') AS month_label, CAST(CAST(trip_pickup_datetime AS DATE) AS VARCHAR) AS pickup_day_date FROM clean",
    "dataset_summary": f"WITH {TRIPS} SELECT count(*) AS n, CAST(CAST(min(trip_pickup_datetime) AS DATE) AS VARCHAR) AS date_min, "
                       "CAST(CAST(max(trip_pickup_datetime) AS DATE) AS VARCHAR) AS date_max FROM trips",
    "hub_centres": f"{WITH_HUB}, {_centres_body()} SELECT {_centres_select()} FROM centres c",
    "hub_profile": f"{WITH_HUB}, {_centres_body()}, means AS (SELECT cluster, avg(passenger_count) AS passenger_count, "
                   "avg(trip_distance) AS trip_distance, avg(fare_amt) AS fare_amt, avg(tip_amt) AS tip_amt FROM hub GROUP BY cluster) "
                   f"SELECT {_centres_select()}, {R('m.passenger_count')} AS passenger_count, {R('m.trip_distance')} AS trip_distance, "
                   f"{R('m.fare_amt')} AS fare_amt, {R('m.tip_amt')} AS tip_amt FROM centres c LEFT JOIN means m ON c.cluster = m.cluster",
    "hub_map_centre": f"{WITH_HUB}, {_centres_body()} SELECT {R('avg(center_lon)')} AS center_lon, "
                      f"{R('avg(center_lat)')} AS center_lat FROM centres",
    "week_hour_heat": _heat_sql(True),
    "week_hour_heat_raw": _heat_sql(False),
    "pickup_density": f"WITH {TRIPS}, {CLEAN} SELECT round(start_lat, 3) AS lat_r, round(start_lon, 3) AS lon_r, "
                      "count(*) AS n FROM clean GROUP BY ALL",
    "pickup_raster": _raster_sql(),
    "fare_histogram": _hist_sql(),
    "fare_cells": f"WITH {TRIPS}, {CLEAN} SELECT round(start_lon, 4) AS lon_r, round(start_lat, 4) AS lat_r, "
                  f"{R('avg(fare_amt)')} AS mean_fare_amt, count(*) AS n FROM clean GROUP BY ALL",
    "rides_by_passengers": f"WITH {TRIPS}, {CLEAN} SELECT lpad(CAST(CAST(passenger_count AS INTEGER) AS VARCHAR), 2, '0') "
                           "AS passengers, count(*) AS n FROM clean GROUP BY ALL",
    "distance_round": f"WITH {TRIPS}, {CLEAN} SELECT round(trip_distance, 1) AS bin, count(*) AS n FROM clean GROUP BY ALL",
    "distance_floor": f"WITH {TRIPS}, {CLEAN} SELECT CAST(floor(trip_distance) AS BIGINT) AS bin, count(*) AS n "
                      "FROM clean GROUP BY ALL",
    "rides_by_hour": f"{WITH_CAL} SELECT pickup_hour, count(*) AS n FROM cal GROUP BY ALL",
    "payment_means": f"WITH {TRIPS}, {CLEAN} SELECT lower(payment_type) AS payment_type, "
                     f"{R('avg(total_amt)')} AS mean_total_amt, {R('avg(tip_amt)')} AS mean_tip_amt FROM clean GROUP BY ALL",
    "fare_percentiles": _percentile_sql(),
    "trip_correlation": _corr_sql(),
    "trip_profile": _profile_sql(),
    "scaled_distance": _scaled_sql(),
    "fare_on_distance": f"WITH {TRIPS}, {CLEAN} SELECT {R('regr_slope(fare_amt, trip_distance)')} AS slope, "
                        f"{R('regr_intercept(fare_amt, trip_distance)')} AS intercept, "
                        f"{R('regr_r2(fare_amt, trip_distance)')} AS r2, CAST(regr_count(fare_amt, trip_distance) AS BIGINT) AS n FROM clean",
    "url_manifest": f"WITH {TRIPS}, m AS (SELECT DISTINCT strftime(trip_pickup_datetime, '%Y') AS year, "
                    "strftime(trip_pickup_datetime, '%m') AS month FROM trips WHERE trip_pickup_datetime IS NOT NULL) "
                    "SELECT year, month, year || '-' || month || '.csv' AS filename, "
                    "'https://s3.amazonaws.com/nyc-tlc/trip+data/yellow_tripdata_' || year || '-' || month || '.csv' AS url, "
                    "'yellow_tripdata_' || year || '-' || month AS title FROM m",
    "prediction_grid": f"{WITH_HUB}, h AS (SELECT DISTINCT cluster FROM hub), d AS (SELECT CAST(range AS INTEGER) AS pickup_nday "
                       "FROM range(1, 8)), hr AS (SELECT CAST(range AS INTEGER) AS pickup_hour FROM range(0, 24)) "
                       "SELECT h.cluster, d.pickup_nday, hr.pickup_hour, "
                       "['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][d.pickup_nday] AS pickup_wday FROM h, d, hr",
    "lonlat_grid": _lonlat_sql(),
    "action_share": f"WITH {FIREWALL} SELECT Action, count(*) AS n, {R('count(*) / (SELECT count(*) FROM firewall)')} "
                    "AS percent FROM firewall GROUP BY ALL",
    "action_by_protocol": _contingency_sql(),
    "top_sources": f"WITH {FIREWALL} SELECT SourceIP, DestinationIP, count(*) AS n FROM firewall GROUP BY ALL",
    "denied_only": f"WITH {FIREWALL} SELECT ident, logTime, SourceIP, DestinationIP, bytessent, "
                   "CAST(CASE WHEN Action = 'Denied' THEN 1 ELSE 0 END AS INTEGER) AS denied FROM firewall WHERE Action = 'Denied'",
    "runlog_union": f"WITH {RUNLOGS} SELECT action, runtime, \"timestamp\", n_row, filesize FROM logs",
    "runlog_latest": f"WITH {RUNLOGS} SELECT action, runtime, \"timestamp\", n_row, filesize FROM logs "
                     "WHERE regexp_matches(action, 'Model:') ORDER BY \"timestamp\" DESC, action DESC, runtime DESC, n_row DESC, filesize DESC LIMIT 1",
    "runlog_totals": f"WITH {RUNLOGS} SELECT action, strftime(\"timestamp\", '%Y-%m') AS run_month, "
                     f"{R('sum(runtime)')} AS total_runtime, count(*) AS steps FROM logs GROUP BY ALL",
    "hash_split_counts": f"WITH {TRIPS}, {CLEAN} SELECT {SPLIT} AS part, count(*) AS n FROM clean GROUP BY ALL",
    "wide_measures": f"{WITH_CAL} SELECT cluster, pickup_nday, pickup_hour, count(*) AS rides, "
                     f"{R('avg(fare_amt)')} AS mean_fare, {R('avg(tip_amt)')} AS mean_tip, "
                     f"{R('avg(trip_distance)')} AS mean_distance FROM cal GROUP BY ALL",
    "first_trip_per_hub": f"{WITH_HUB} SELECT cluster, arg_min(trip_id, (trip_pickup_datetime, trip_id)) AS trip_id, "
                          "min(trip_pickup_datetime) AS trip_pickup_datetime FROM hub GROUP BY cluster",
    "distinct_pairs": f"WITH {TRIPS}, {CLEAN} SELECT DISTINCT lower(payment_type) AS payment_type, vendor_name FROM clean",
    "weekday_rides": f"{WITH_CAL} SELECT pickup_nday, count(*) AS n, "
                     "['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][pickup_nday] AS pickup_wday FROM cal GROUP BY pickup_nday",
    "trip_labels": f"{WITH_CAL} SELECT trip_id, lpad(CAST(pickup_hour AS VARCHAR), 2, '0') AS hour_label, "
                   "vendor_name || '-' || CAST(trip_id AS VARCHAR) AS trip_key, "
                   "split_part(vendor_name || '-' || CAST(trip_id AS VARCHAR), '-', 1) AS key_part, "
                   "split_part(vendor_name || '-' || CAST(trip_id AS VARCHAR), '-', 2) AS id_part, "
                   "regexp_replace(lower(payment_type), ' |-', '', 'g') AS payment_code, "
                   "coalesce(CASE lower(payment_type) WHEN 'cash' THEN 'CSH' WHEN 'credit' THEN 'CRD' END, lower(payment_type)) AS payment_short, "
                   f"'$' || format('{{:,.2f}}', {R('fare_amt', 2)}) AS fare_label, format('{{:,}}', trip_id) AS trip_number, "
                   "CAST(CASE WHEN tip_amt > 0 THEN 1 ELSE 0 END AS INTEGER) AS tipped, "
                   f"{R('greatest(tip_amt - 1.0E0, 0.0E0)')} AS tip_over_1 FROM cal",
}


ORACLES.update({
    "csv_roundtrip": f"WITH {TRIPS} SELECT * FROM trips",
    "csv_inferred": f"WITH {TRIPS} SELECT * FROM trips",
    "csv_strings": f"WITH {TRIPS} SELECT * FROM trips",
    "parquet_append": f"WITH {TRIPS} SELECT * FROM trips",
    "json_roundtrip": f"WITH {TRIPS}, {CLEAN} SELECT * FROM clean",
    "orc_roundtrip": f"WITH {TRIPS}, {CLEAN} SELECT * FROM clean",
    "csv_combine": f"WITH {TRIPS} SELECT trip_id, vendor_name, fare_amt, CAST(NULL AS DOUBLE) AS tip_amt "
                   "FROM trips WHERE vendor_name = 'VTS' UNION ALL SELECT trip_id, vendor_name, "
                   "CAST(NULL AS DOUBLE) AS fare_amt, tip_amt FROM trips WHERE vendor_name = 'CMT'",
    "checkpoint_roundtrip": f"WITH {TRIPS}, {CLEAN} SELECT trip_id, vendor_name, fare_amt FROM clean",
    "persisted_distinct": f"WITH {TRIPS}, {CLEAN} SELECT DISTINCT vendor_name, passenger_count FROM clean",
    "stream_project": f"WITH {TRIPS} SELECT trip_id, trip_pickup_datetime, fare_amt FROM trips",
    "stream_hub_scores": f"{WITH_CAL} SELECT trip_id, cluster, pickup_wday, pickup_nday, pickup_hour, "
                         "fare_amt, trip_distance FROM cal",
    "stream_hub_hours": f"{WITH_HUB} SELECT cluster, date_trunc('hour', trip_pickup_datetime) AS window_start, "
                        "count(*) AS rides FROM hub GROUP BY ALL",
    "stream_model_check": "SELECT CAST(0 AS BIGINT) AS mismatches",
    "dev_sample_check": "SELECT TRUE AS within_cap, CAST(0 AS BIGINT) AS missing, TRUE AS cap_reached",
    "random_split_check": "SELECT TRUE AS parts_sum_to_whole, CAST(0 AS BIGINT) AS overlap",
    "kmeans_check": "SELECT TRUE AS centres_ok, CAST(0 AS BIGINT) AS misassigned, TRUE AS sizes_ok, CAST(5 AS BIGINT) AS k_found",
    "linreg_check": "SELECT TRUE AS rides_residuals_ok, TRUE AS fpm_residuals_ok, TRUE AS stagewise_equal, TRUE AS slots_ok",
    "glm_check": "SELECT TRUE AS wls_ok, TRUE AS gaussian_ok, TRUE AS poisson_ok, TRUE AS tweedie_ok, TRUE AS gamma_ok",
    "tree_check": "SELECT TRUE AS gbt_ok, TRUE AS tree_ok",
    "forest_check": "SELECT TRUE AS probs_sum_to_1, CAST(0 AS BIGINT) AS argmax_mismatch, TRUE AS importances_sum_to_1",
    "model_reload_check": "SELECT CAST(0 AS BIGINT) AS mismatches, TRUE AS sizes_equal",
    "scaler_check": "SELECT TRUE AS scaler_ok, TRUE AS binarizer_ok, TRUE AS normalizer_ok, TRUE AS indexer_ok",
    "embedding_clusters_check": "SELECT TRUE AS sizes_ok, TRUE AS k_ok, TRUE AS cost_ok, TRUE AS cv_ok",
})


ORACLES.update({
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in
                                       ["lineitem", "orders", "customer", "part", "supplier", "nation", "region",
                                        "events", "embeddings", "documents", "pages", "benchmark", "labels",
                                        "conversations"]),
    "hub_weekday_wide": f"{WITH_CAL} SELECT cluster, " + ", ".join(
        f"count(*) FILTER (WHERE pickup_wday = '{d}') AS {d}" for d in ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])
        + " FROM cal GROUP BY cluster",
    "hub_share_broadcast": f"{WITH_HUB}, {_centres_body()}, counts AS (SELECT cluster, payment_type, count(*) AS n "
                           "FROM hub GROUP BY ALL) SELECT k.cluster, k.payment_type, k.n, c.taxi_hub, "
                           f"{R('c.hub_pct')} AS hub_pct FROM counts k LEFT JOIN centres c ON k.cluster = c.cluster",
    "earliest_trip": f"WITH {TRIPS}, {CLEAN} SELECT trip_pickup_datetime, trip_id FROM clean "
                     "ORDER BY trip_pickup_datetime, trip_id LIMIT 1",
    "runlog_stack": f"WITH {RUNLOGS} SELECT action, runtime, \"timestamp\", n_row, filesize FROM log_a "
                    "UNION ALL SELECT action, runtime, \"timestamp\", n_row, filesize FROM log_b",
    "tipped_north": f"{WITH_HUB}, t AS (SELECT cluster, start_lat AS lat, CASE WHEN fare_amt < 10 THEN 'low' "
                    "WHEN fare_amt < 30 THEN 'mid' ELSE 'high' END AS fare_band FROM hub "
                    "WHERE tip_amt > 0 AND start_lat < 40.8E0) "
                    f"SELECT cluster, fare_band, count(*) AS n, {R('avg(lat)')} AS mean_lat FROM t GROUP BY ALL",
    "text_formats": f"WITH {TRIPS}, {CLEAN} SELECT trip_id, vendor_name || '/' || strftime(trip_pickup_datetime, '%Y-%m') AS label, "
                    "regexp_replace(lower(payment_type), 'a', 'A') AS payment_first, "
                    f"{R('round(fare_amt * 1e9 / 1073741824.0E0, 2)')} AS fare_gb, format('{{:,}}', trip_id) AS fare_k, "
                    f"CAST(NULL AS DOUBLE) AS no_value, {R('ln(fare_amt)')} AS log_fare, {R('round(fare_amt, 1)')} AS fare_amt, {R('round(tip_amt, 1)')} AS tip_amt FROM clean",
    "hourly_sql_stage": ORACLES["hourly_hub_rates"],
})


ORACLES.update({
    "ingest_loop": f"WITH {TRIPS} SELECT * FROM trips",
    "summary_bundle": ORACLES["week_hour_heat"],
})

ORACLES.update({
    "firewall_kmeans_check": "SELECT CAST(0 AS BIGINT) AS misassigned, TRUE AS sizes_ok",
    "logistic_check": "SELECT TRUE AS probs_ok, TRUE AS auc_ok",
})

ORACLES.update({"stream_batch_scores_check": "SELECT CAST(0 AS BIGINT) AS mismatches"})

ORACLES.update({"ingest_one_job": f"WITH {TRIPS} SELECT * FROM trips"})

ORACLES.update({
    "firewall_csv_typed": f"WITH {FIREWALL} SELECT ident, logTime, 'fw01' AS servername, SourceIP, DestinationIP, Action, rule, "
                          "ApplicationProtocol, bytessent, bytesrecvd, Action = 'Denied' AS Payload, "
                          "CAST(ident AS BIGINT) % 2 = 0 AS IPHeader, TRUE AS rest_empty FROM firewall",
})

ORACLES.update({
    "model_summaries_check": "SELECT TRUE AS centres_sum_ok, TRUE AS heat_sum_ok, TRUE AS heat_complete, "
                             "TRUE AS density_cap_ok, TRUE AS summary_ok, TRUE AS letters_ok",
})

ORACLES.update({
    "hub_hour_complete": f"{WITH_CAL}, agg AS (SELECT cluster, pickup_hour, count(*) AS rides FROM cal GROUP BY ALL) "
                         "SELECT c.cluster, h.pickup_hour, coalesce(a.rides, 0) AS rides "
                         "FROM (SELECT DISTINCT cluster FROM agg) c CROSS JOIN (SELECT DISTINCT pickup_hour FROM agg) h "
                         "LEFT JOIN agg a ON a.cluster = c.cluster AND a.pickup_hour = h.pickup_hour",
})

ORACLES.update({
    "grid_predictions_check": "SELECT TRUE AS grid_complete, TRUE AS all_predicted, TRUE AS rides_clipped",
    "file_manifest_check": "SELECT TRUE AS one_row_per_file, TRUE AS sizes_positive, TRUE AS titles_ok, TRUE AS files_found",
})

ORACLES.update({"density_cap_check": "SELECT TRUE AS size_ok, CAST(0 AS BIGINT) AS foreign_cells, TRUE AS distinct_cells"})

ORACLES.update({
    "url_calendar": f"WITH {TRIPS}, seen AS (SELECT DISTINCT year(trip_pickup_datetime) AS y, month(trip_pickup_datetime) AS m FROM trips "
                    "WHERE trip_pickup_datetime IS NOT NULL), grid AS (SELECT y, m FROM (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM seen) ys, "
                    "(SELECT unnest(range(1, 13)) AS m) ms), named AS (SELECT y, m, CAST(y AS VARCHAR) AS year, lpad(CAST(m AS VARCHAR), 2, '0') AS month FROM grid) "
                    "SELECT year, month, year || '-' || month || '.csv' AS filename, "
                    "'https://s3.amazonaws.com/nyc-tlc/trip+data/yellow_tripdata_' || year || '-' || month || '.csv' AS url, "
                    "EXISTS (SELECT 1 FROM seen s WHERE s.y = n.y AND s.m = n.m) AS seen FROM named n",
    "runlog_env_totals": "SELECT CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'laptop' END AS run_env, "
                         "CASE WHEN event_id % 3 = 0 THEN '10G' ELSE '1G' END AS run_ram, CAST(event_id % 5 * 10000 AS DOUBLE) AS n_row, "
                         "CASE event_type WHEN 'view' THEN 'Model: Fit' WHEN 'click' THEN 'Write: file' ELSE 'Load: file' END AS action, "
                         f"{R('sum(value)')} AS total_runtime, count(*) AS steps FROM events GROUP BY 1, 2, 3, 4",
    "weekday_hour_rates": f"{WITH_CAL}, w AS (SELECT cluster, pickup_nday, pickup_wday, pickup_hour, count(*) AS rides, "
                          "sum(passenger_count) AS passengers, sum(trip_distance) AS distance, sum(fare_amt) AS fare, sum(tip_amt) AS tip "
                          "FROM cal GROUP BY ALL) SELECT cluster, pickup_nday, pickup_wday, pickup_hour, rides, "
                          + ", ".join(f"{R(c)} AS {c}" for c in ("passengers", "distance", "fare", "tip")) + ", "
                          + ", ".join(f"{R(f'{a} / {b}')} AS {n}" for n, a, b in (
                              ("ppr", "passengers", "rides"), ("dpr", "distance", "rides"), ("fpr", "fare", "rides"),
                              ("tpr", "tip", "rides"), ("fpm", "fare", "distance"), ("tpm", "tip", "distance"))) + " FROM w",
    "first_seen_rank": f"WITH {TRIPS}, l AS (SELECT trip_id % 1009 AS level, min(trip_id) AS seen FROM trips GROUP BY 1) "
                       "SELECT level, row_number() OVER (ORDER BY seen, level) AS level_rank FROM l",
    "pipeline_refit_check": "SELECT CAST(0 AS BIGINT) AS mismatches",
})


# ------------------------------------------------------------ least squares by elimination

RESPONSES = ["rides", "ppr", "dpr", "fpr", "tpr", "fpm", "tpm"]
_LEVELS = [0, 1, 2, 3], ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
SLOTS = ([("(intercept)", None)] + [("cluster", str(v)) for v in _LEVELS[0]] + [("pickup_wday", v) for v in _LEVELS[1]]
         + [("pickup_hour", None)])
_SLOT_EXPRS = (["1.0E0"] + [f"(cluster = {v})::INT::DOUBLE" for v in _LEVELS[0]]
               + [f"(pickup_wday = '{v}')::INT::DOUBLE" for v in _LEVELS[1]] + ["pickup_hour::DOUBLE"])


def _least_squares() -> str:
    """CTEs up to ``beta`` (i, v): the coefficients of every slot, one per response (Gauss-Jordan, one step a slot)."""
    p, q = len(SLOTS), len(RESPONSES)
    steps = [f"""{WITH_CAL}, {HOURLY},
rated AS (SELECT cluster, pickup_wday, pickup_hour, rides::DOUBLE AS rides, passengers / rides AS ppr, distance / rides AS dpr,
  fare / rides AS fpr, tip / rides AS tpr, fare / distance AS fpm, tip / distance AS tpm FROM hourly),
design AS MATERIALIZED (SELECT [{', '.join(_SLOT_EXPRS)}] AS x, [{', '.join(RESPONSES)}] AS y FROM rated),
s0 AS MATERIALIZED (SELECT i, list(s ORDER BY j) AS v FROM (SELECT i, j, sum(x[i] * list_concat(x, y)[j]) AS s
  FROM design, range(1, {p + 1}) a(i), range(1, {p + q + 1}) b(j) GROUP BY i, j) GROUP BY i)"""]
    for k in range(1, p + 1):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT r.i, CASE WHEN r.i = {k} THEN list_transform(r.v, lambda x: x / p.v[{k}])
  ELSE list_transform(list_zip(r.v, p.v, list_resize([]::DOUBLE[], len(r.v), r.v[{k}] / p.v[{k}])), lambda z: z[1] - z[2] * z[3]) END AS v
  FROM s{k - 1} r, (SELECT v FROM s{k - 1} WHERE i = {k}) p)""")
    return ",\n".join(steps) + f",\nbeta AS MATERIALIZED (SELECT i, v[{p + 1}:{p + q}] AS b FROM s{p})"


def _coefficients_sql() -> str:
    names = ", ".join(f"('{r}', {k})" for k, r in enumerate(RESPONSES, 1))
    slots = ", ".join(f"({i}, '{t}', {'NULL' if v is None else repr(v)})" for i, (t, v) in enumerate(SLOTS, 1))
    return f"""{_least_squares()},
names AS (SELECT * FROM (VALUES {names}) t(response, k)), slots AS (SELECT * FROM (VALUES {slots}) t(i, term, level)),
whole AS MATERIALIZED (SELECT k, list(b[k] ORDER BY i) AS w FROM beta, names GROUP BY k),
fitted AS (SELECT k, y[k] AS y, list_sum(list_transform(list_zip(x, w), lambda z: z[1] * z[2])) AS p FROM design, whole),
figures AS (SELECT k, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM fitted GROUP BY k)
SELECT response, term, level, n, {R('b[k]')} AS coefficient, {R('rmse')} AS rmse, {R('r2')} AS r2
FROM beta JOIN slots USING (i), names JOIN figures USING (k)"""


def _grid_sql() -> str:
    days = ", ".join(f"({d}, '{name}')" for d, name in enumerate(["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"], 1))
    dot = "list_sum(list_transform(list_zip(x, (SELECT list(b[{k}] ORDER BY i) FROM beta)), lambda z: z[1] * z[2]))"
    preds = ", ".join(f"{R(f'greatest({dot.format(k=k)}, 0)' if r == 'rides' else dot.format(k=k), 4)} AS p_{r}" for k, r in enumerate(RESPONSES, 1))
    return f"""{_least_squares()},
grid AS (SELECT cluster, pickup_nday, pickup_wday, pickup_hour::INT AS pickup_hour FROM (SELECT DISTINCT cluster FROM hourly),
  (VALUES {days}) d(pickup_nday, pickup_wday), range(24) h(pickup_hour)),
coded AS (SELECT *, [{', '.join(_SLOT_EXPRS)}] AS x FROM grid)
SELECT cluster, pickup_nday, pickup_wday, pickup_hour, {preds} FROM coded"""


ORACLES.update({
    "gram_coefficients": _coefficients_sql(),
    "grid_predictions": _grid_sql(),
    "gram_linreg_check": "SELECT TRUE AS predictions_equal, TRUE AS figures_equal",
    "kmeans_collapsed_check": "SELECT TRUE AS centres_ok, TRUE AS cost_ok",
})


# ------------------------------------------------------------ arriving data

_ARRIVAL = """(CASE WHEN trip_pickup_datetime < TIMESTAMP '1994-06-01' THEN CASE WHEN trip_id % 50 = 0 THEN 3 ELSE 1 END
  WHEN trip_pickup_datetime < TIMESTAMP '1996-09-01' THEN 2 ELSE 3 END)"""

ORACLES.update({
    # The watermark after an arrival is the latest pickup so far less two hours; a trip is late if its hour has ended by
    # the watermark of the arrivals before its own, and an hour is emitted once it has ended by the last watermark.
    "stream_closed_hours": f"""{WITH_HUB},
arrived AS (SELECT *, {_ARRIVAL} AS arrival, date_trunc('hour', trip_pickup_datetime) AS window_start FROM hub),
marks AS (SELECT arrival, max(max(trip_pickup_datetime)) OVER (ORDER BY arrival) - INTERVAL 2 HOUR AS mark FROM arrived GROUP BY arrival),
kept AS (SELECT a.* FROM arrived a LEFT JOIN marks m ON m.arrival = a.arrival - 1
  WHERE m.mark IS NULL OR a.window_start + INTERVAL 1 HOUR > m.mark)
SELECT cluster, window_start, count(*) AS rides, {R('sum(fare_amt)')} AS fare FROM kept
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM marks) GROUP BY cluster, window_start""",
    "stream_hour_rates": f"""{WITH_CAL}, {HOURLY}
SELECT cluster, pickup_year, pickup_mon, pickup_nday, pickup_hour, rides, {R('passengers')} AS passengers, {R('distance')} AS distance,
  {R('fare')} AS fare, {R('tip')} AS tip, {R('fare / rides')} AS fpr, {R('tip / distance')} AS tpm FROM hourly""",
    "ingest_ledger": f"""WITH {TRIPS}, t AS (SELECT *, CASE WHEN vendor_name = 'VTS' THEN 1 ELSE 2 END AS batch, trip_id % 97 IN (3, 5, 7) AS bad FROM trips)
SELECT batch::INT AS batch, count_if(NOT bad) AS n_rows, count_if(bad) AS bad_lines, TRUE AS has_size, count_if(NOT bad) AS seen,
  sum(trip_id) FILTER (NOT bad) AS trip_ids, {R('sum(fare_amt) FILTER (NOT bad)', 4)} AS fare FROM t GROUP BY batch""",
    "ingest_quarantine": f"""WITH {TRIPS}, t AS (SELECT CASE WHEN vendor_name = 'VTS' THEN 1 ELSE 2 END AS batch, trip_id % 97 AS kind FROM trips)
SELECT batch::INT AS batch, CASE kind WHEN 3 THEN 'Fare_Amt: not a value of type double' WHEN 5 THEN '18 values for 19 columns'
  ELSE '20 values for 19 columns' END AS reason, count(*) AS n FROM t WHERE kind IN (3, 5, 7) GROUP BY 1, 2""",
    "replace_month": f"""WITH {TRIPS}, {CLEAN}, t AS (SELECT strftime(trip_pickup_datetime, '%Y-%m') AS month, fare_amt FROM clean)
SELECT month, count(*) AS rides, {R("sum(fare_amt * CASE WHEN month = '1995-03' THEN 2 ELSE 1 END)", 4)} AS fare, month = '1995-03' AS replaced
FROM t GROUP BY month""",
})


def _decile_sql() -> str:
    parts = [f"SELECT '{c}' AS term, {p / 10!r}E0 AS percentile, {R(f'quantile_cont({c}, {p / 10!r})')} AS value FROM clean"
             for c in ("trip_distance", "tip_amt") for p in range(11)]
    return f"WITH {TRIPS}, {CLEAN} " + " UNION ALL ".join(parts)


_GAPS = f"""WITH {TRIPS}, {CLEAN}, gaps AS (SELECT passenger_count, trip_distance,
  CASE WHEN trip_id % 5 = 0 OR trip_id % 7 = 0 THEN NULL ELSE fare_amt END AS fare_or_none FROM clean)"""


def _correlation_rules_sql(ranks: bool) -> str:
    columns = ["passenger_count", "trip_distance", "fare_or_none"]
    parts = []
    for rule in ("pairwise", "listwise"):
        for i in range(3):
            for j in range(i + 1, 3):
                x, y = columns[j], columns[i]
                known = [x, y] if rule == "pairwise" else columns
                rows = "SELECT * FROM gaps WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in known)
                side = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)" if ranks else "{0}"
                parts.append(f"SELECT '{x}' AS term_x, '{y}' AS term_y, '{rule}' AS rule, {R('corr(a, b)')} AS corr "
                             f"FROM (SELECT {side.format(x)}::DOUBLE AS a, {side.format(y)}::DOUBLE AS b FROM ({rows}))")
    return _GAPS + " " + " UNION ALL ".join(parts)


def _pyramid_sql(resolution: int) -> str:
    step = 1000 // resolution
    edge = lambda c, lo, hi: f"(({hi}) - ({lo})) / {float(resolution)!r}E0 * {c} + ({lo})"
    return f"""WITH {TRIPS}, {CLEAN}, b AS (SELECT min(start_lon) AS x0, max(start_lon) AS x1, min(start_lat) AS y0, max(start_lat) AS y1 FROM clean),
fine AS (SELECT {_bins('start_lon', 'x0', 'x1', 1000)} // {step} AS x_bin, {_bins('start_lat', 'y0', 'y1', 1000)} // {step} AS y_bin FROM clean, b),
cells AS (SELECT x_bin::INT AS x_bin, y_bin::INT AS y_bin, count(*) AS n FROM fine GROUP BY 1, 2)
SELECT x_bin, y_bin, n, {R(edge('x_bin', 'x0', 'x1'))} AS start_lon, {R(edge('y_bin', 'y0', 'y1'))} AS start_lat FROM cells, b"""


ORACLES.update({
    "fare_deciles": _decile_sql(),
    "rank_correlation": _correlation_rules_sql(True),
    "correlation_rules": _correlation_rules_sql(False),
    **{f"raster_{r}": _pyramid_sql(r) for r in (10, 100, 500, 1000)},
    "many_hubs": f"""WITH {TRIPS}, {CLEAN},
centres AS (SELECT i, -74.05E0 + (i * 7919 % 10000) * (0.3E0 / 10000) AS x, 40.58E0 + (i * 104729 % 9973) * (0.32E0 / 9973) AS y FROM range(10000) t(i)),
places AS (SELECT start_lon, start_lat, count(*) AS n, sum(trip_id) AS ids FROM clean GROUP BY 1, 2),
near AS (SELECT start_lon, start_lat, min({{'d': (start_lon - x) * (start_lon - x) + (start_lat - y) * (start_lat - y), 'h': i}}).h AS h
  FROM places, centres GROUP BY 1, 2)
SELECT h::INT AS cluster, sum(n)::BIGINT AS rides, sum(ids)::BIGINT AS trip_ids FROM near JOIN places USING (start_lon, start_lat) GROUP BY h""",
    "hashed_check": "SELECT CAST(0 AS BIGINT) AS misassigned, TRUE AS sizes_ok, TRUE AS failures_found",
    "forest_check": "SELECT TRUE AS probs_sum_to_1, CAST(0 AS BIGINT) AS argmax_mismatch, TRUE AS importances_sum_to_1, "
                    "TRUE AS failures_found, TRUE AS importance_found",
    "file_manifest_check": "SELECT CAST(0 AS BIGINT) AS different_files, TRUE AS rows_complete, TRUE AS titles_ok",
    "bundle_density": ORACLES["pickup_density"],
    "runlog_steps": "SELECT 'Count: lineitem' AS action, 'query' AS run_env, count(*) AS n_row, TRUE AS timed FROM lineitem UNION ALL "
                    "SELECT 'Count: events', 'query', count(*), TRUE FROM events UNION ALL SELECT 'Count: embeddings', 'query', count(*), TRUE FROM embeddings",
    "payment_names": f"""WITH {TRIPS}, {CLEAN} SELECT p.payment, p.paid, count(*) AS rides FROM clean
LEFT JOIN (VALUES ('Cash', 'cash', TRUE), ('CREDIT', 'card', TRUE), ('Dispute', 'disputed', FALSE)) p(payment_type, payment, paid) USING (payment_type)
GROUP BY p.payment, p.paid""",
})
