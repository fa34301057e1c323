"""Property tests (hypothesis) of operator invariants on small generated inputs."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hubcast.operators import sampling, stats
from hubcast.operators.clean import TripBounds, plausibility_condition

FLOATS = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(FLOATS, min_size=1, max_size=40), st.integers(min_value=1, max_value=50))
def test_bins_stay_in_range_and_count_everything(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = stats.histogram(df, "x", bins).collect()
    assert all(0 <= r["bin"] < bins for r in h)
    assert sum(r["n"] for r in h) == len(xs)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=60, unique=True))
def test_hash_split_is_a_partition(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    parts = df.select(sampling.hash_split_label("k", {"a": 0.6, "b": 0.3, "c": 0.1}).alias("p")).collect()
    assert len(parts) == len(keys) and {r["p"] for r in parts} <= {"a", "b", "c"}


@settings(max_examples=15, deadline=None)
@given(st.tuples(*[st.floats(min_value=-80, max_value=80, allow_nan=False)] * 4),
       st.floats(min_value=-1, max_value=10, allow_nan=False), st.floats(min_value=-5, max_value=150, allow_nan=False),
       st.floats(min_value=-5, max_value=50, allow_nan=False))
def test_plausibility_matches_python_predicate(spark, coords, pax, dist, total):
    b = TripBounds()
    row = (*coords, pax, dist, total)
    cols = "start_lon double, start_lat double, end_lon double, end_lat double, passenger_count double, " \
           "trip_distance double, total_amt double"
    got = spark.createDataFrame([row], cols).where(plausibility_condition(b, require_pickup=False)).count()
    sl, sa, el, ea = coords
    want = (b.lon_min < sl < b.lon_max and b.lat_min < sa < b.lat_max and b.lon_min < el < b.lon_max
            and b.lat_min < ea < b.lat_max and b.passengers_min < pax < b.passengers_max
            and b.distance_min < dist < b.distance_max and total > b.total_min)
    assert got == int(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20), min_size=2, max_size=80),
       st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_distributed_percentiles_equal_aggregate(spark, xs, probs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    a = sorted(stats.percentiles(df, "x", tuple(probs)).collect())
    b = sorted(stats.percentiles(df, "x", tuple(probs), method="aggregate").collect())
    assert all(abs(p[1] - q[1]) < 1e-9 for p, q in zip(a, b))
