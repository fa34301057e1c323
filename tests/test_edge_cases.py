"""Literal edge cases of the operators (FIXTURES part 3)."""
import datetime as dt
import math

from pyspark.sql import functions as F

from hubcast.operators import clean, grid, hubs, rollup, sampling, stats
from hubcast.operators.clean import plausible_trips

COLS = ("start_lon double, start_lat double, end_lon double, end_lat double, passenger_count double, "
        "trip_distance double, total_amt double, trip_pickup_datetime timestamp_ntz")
OK = (-73.9, 40.7, -73.9, 40.7, 1.0, 1.0, 10.0, dt.datetime(2009, 1, 1, 10))


def _trip(**over):
    names = [c.split()[0] for c in COLS.split(", ")]
    row = dict(zip(names, OK))
    row.update(over)
    return tuple(row[n] for n in names)


def test_box_bounds_are_open(spark):
    rows = [_trip(start_lon=-74.05), _trip(start_lon=-73.75), _trip(start_lat=40.58), _trip(end_lat=40.90), _trip()]
    assert plausible_trips(spark.createDataFrame(rows, COLS)).count() == 1


def test_passenger_and_distance_ranges(spark):
    rows = [_trip(passenger_count=p) for p in (0.0, 1.0, 6.0, 7.0)]
    kept = plausible_trips(spark.createDataFrame(rows, COLS)).select("passenger_count").collect()
    assert sorted(r[0] for r in kept) == [1.0, 6.0]
    rows = [_trip(trip_distance=d) for d in (0.0, 0.1, 99.9, 100.0)]
    kept = plausible_trips(spark.createDataFrame(rows, COLS)).select("trip_distance").collect()
    assert sorted(r[0] for r in kept) == [0.1, 99.9]


def test_null_pickup_dropped_nan_total_kept(spark):
    rows = [_trip(trip_pickup_datetime=None), _trip(total_amt=float("nan"))]
    kept = plausible_trips(spark.createDataFrame(rows, COLS)).collect()
    assert len(kept) == 1 and math.isnan(kept[0]["total_amt"])


def test_zero_distance_rate_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, 3.0, 1.0)], "rides long, passengers double, distance double, "
                                                          "fare double, tip double")
    r = rollup.unit_rates(df).collect()[0]
    assert r["fpm"] is None and r["tpm"] is None and r["fpr"] == 3.0


def test_new_year_uses_calendar_year(spark):
    days = [dt.datetime(2008, 12, 28) + dt.timedelta(days=i) for i in range(7)]
    df = spark.createDataFrame([(d,) for d in days], "trip_pickup_datetime timestamp_ntz")
    got = rollup.with_calendar(df).select("pickup_year", "pickup_day").collect()
    assert [r[0] for r in got] == ["2008"] * 4 + ["2009"] * 3
    assert got[3][1] == "31"


def test_raster_max_in_last_bin_and_constant_column(spark):
    df = spark.range(0, 11).select(F.col("id").cast("double").alias("x"), F.lit(5.0).alias("y"))
    r = stats.raster(df, "x", "y", 10).collect()
    assert max(row["x_bin"] for row in r) == 9
    assert {row["y_bin"] for row in r} == {0}
    assert sum(row["n"] for row in r) == 11
    h = stats.histogram(df, "y", 30).collect()
    assert [(row["bin"], row["n"]) for row in h] == [(0, 11)]


def test_densify_only_observed_values(spark):
    df = spark.createDataFrame([("Mon", 0, 5), ("Tue", 1, 2)], "pickup_wday string, pickup_hour int, rides long")
    out = grid.densify(df, ["pickup_wday", "pickup_hour"], fill={"rides": 0}).collect()
    assert sorted((r[0], r[1], r[2]) for r in out) == [("Mon", 0, 5), ("Mon", 1, 0), ("Tue", 0, 0), ("Tue", 1, 2)]


def test_densify_rejects_unknown_fill(spark):
    df = spark.createDataFrame([("Mon", 0, 5)], "a string, b int, n long")
    try:
        grid.densify(df, ["a", "b"], fill={"passengers": 0})
    except ValueError:
        return
    raise AssertionError("unknown fill accepted")


def test_equal_hub_sizes_letter_by_id(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (0, 1.0, 1.0)], "cluster int, start_lon double, start_lat double")
    out = {r["cluster"]: r["taxi_hub"] for r in hubs.hub_centres(df).collect()}
    assert out == {0: "A", 1: "B"}


def test_cap_with_fewer_rows(spark):
    df = spark.range(3)
    assert sampling.sample_n(df, 10_000).count() == 3


def test_nearest_hub_ties_to_lower_id(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "start_lon double, start_lat double")
    out = hubs.assign_hubs(df, centres=[(1.0, 0.0), (-1.0, 0.0)]).collect()[0]["cluster"]
    assert out == 0


def test_level_rank_and_lookup(spark):
    df = spark.createDataFrame([("Sun",), ("Mon",)], "w string")
    got = df.select(clean.level_rank("w", clean.WEEKDAYS_MON_FIRST).alias("r")).collect()
    assert [r[0] for r in got] == [7, 1]
    lk = grid.weekday_lookup(spark).collect()
    assert [(r[0], r[1]) for r in lk][:2] == [(1, "Sun"), (2, "Mon")]


def test_hash_split_is_layout_independent(spark):
    a = spark.range(1000).repartition(7)
    b = spark.range(1000).coalesce(1)
    lab = sampling.hash_split_label("id", {"a": 0.6, "b": 0.4})
    la = {r[0]: r[1] for r in a.select("id", lab).collect()}
    lb = {r[0]: r[1] for r in b.select("id", lab).collect()}
    assert la == lb


def test_first_appearance_rank(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x")], "t int, v string")
    got = {r[0]: r[1] for r in clean.first_appearance_rank(df, "v", "t").collect()}
    assert got == {"y": 1, "x": 2}


def test_distributed_percentiles_match_aggregate_with_hot_value(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.rand(1) * 100).alias("x"))
    probs = (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)
    a = sorted(stats.percentiles(df, "x", probs).collect())
    b = sorted(stats.percentiles(df, "x", probs, method="aggregate").collect())
    assert all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b))
