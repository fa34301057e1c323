"""Figures that must follow the input: parts of a read, micro-batches of a stream, work of a row, passes of a refit."""
from pyspark.sql import functions as F

from hubcast.session import shared_dir
from hubcast.sources import io


def _with_conf(spark, confs, run):
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repartitioned_csv_has_a_part_for_every_split(spark):
    rows = spark.range(20_000).select("id", F.lit("x" * 40).alias("text"))
    path = io.write_csv(rows.coalesce(1), shared_dir(spark, "csv-parts"))
    small = io.read_csv(spark, path, repartition=3)
    assert small.rdd.getNumPartitions() == 3
    conf = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    read = lambda: io.read_csv(spark, path, repartition=3)
    parts = _with_conf(spark, conf, lambda: read().rdd.glom().map(len).collect())
    assert len(parts) >= 12 and sum(parts) == 20_000 and max(parts) < 20_000 / 3
    whole = _with_conf(spark, conf, lambda: sorted(int(r["id"]) for r in read().select("id").collect()))
    assert whole == list(range(20_000))


def test_rollup_keys_are_the_formatted_pickup_time(spark):
    from hubcast.ml.pipelines import ROLLUP_STATEMENT, rollup_transformer
    inner = ROLLUP_STATEMENT.split("FROM (")[1]
    assert "date_format" not in inner  # text is made for hours, not for trips
    times = ["2009-01-31 23:59:59", "2012-02-29 00:00:00", "0987-06-05 04:03:02", "2009-01-04 10:00:00", "2009-01-11 10:30:00",
             "2009-01-05 10:00:00", "2009-01-06 10:00:00", "2009-01-07 10:00:00", "2009-01-08 10:00:00", "2009-01-09 10:00:00", None]
    rows = [(i % 2, t, 1.0, 2.0, float(i), 0.5) for i, t in enumerate(times)]
    for kind in ("timestamp_ntz", "timestamp"):
        trips = (spark.createDataFrame(rows, "cluster int, t string, passenger_count double, trip_distance double, fare_amt double, tip_amt double")
                 .withColumn("trip_pickup_datetime", F.col("t").cast(kind)))
        keys = ["cluster", "pickup_year", "pickup_mon", "pickup_wday", "pickup_nday", "pickup_hour"]
        at = F.col("trip_pickup_datetime")
        plain = trips.select("cluster", F.date_format(at, "yyyy").alias(keys[1]), F.date_format(at, "MM").alias(keys[2]),
                             F.date_format(at, "E").alias(keys[3]), F.dayofweek(at).alias(keys[4]), F.hour(at).alias(keys[5]), "fare_amt")
        want = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("rides"), F.sum("fare_amt").alias("fare")).collect()
        got = rollup_transformer().transform(trips).select(*keys, "rides", "fare").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_batches_of_a_drained_stream_are_bounded(spark):
    from pyspark.sql import types as T
    from hubcast.streaming import jobs
    src, sink, ckpt = (shared_dir(spark, f"batches-{x}") for x in ("in", "out", "ckpt"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    spark.range(0, 100, 1, 21).write.mode("append").parquet(src)
    n = jobs.files_per_batch(spark, src, schema, batches=4)
    assert n == 6 and jobs.files_per_batch(spark, src, schema, batches=50) == 1
    stream = jobs.file_stream(spark, src, schema, "parquet", n).groupBy((F.col("id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    jobs.run_updates(stream, sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.select("epoch").distinct().count() == 4
    last = out.groupBy("k").agg(F.max_by("rows", "epoch").alias("rows")).agg(F.sum("rows")).first()[0]
    assert last == 100


def test_squared_distances_touch_the_slots_held(spark):
    from pyspark.ml.linalg import Vectors
    from hubcast.ml import hashed
    centres = [[0.5, -1.0, 0.0, 2.0], [0.0, 0.0, 0.0, 0.0], [1.0, 0.25, 3.0, -0.125]]
    vectors = [Vectors.sparse(4, [1, 3], [1.0, 2.0]), Vectors.dense([1.0, 0.0, -2.0, 0.5]), Vectors.sparse(4, [], []), Vectors.sparse(4, [0], [3.0])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["id", "features"])
    got = {r["id"]: r["d"] for r in df.select("id", hashed.squared_distances("features", centres).alias("d")).collect()}
    for i, v in enumerate(vectors):
        want = [sum((a - b) ** 2 for a, b in zip(v.toArray(), c, strict=True)) for c in centres]
        assert all(abs(a - b) <= 1e-12 for a, b in zip(got[i], want, strict=True))


def _shuffled_bytes(df):
    """Bytes that the exchanges of ``df`` wrote, after a run of it."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        if inner is not None:
            plans.append(inner)
            continue
        if kind == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleBytesWritten").value()
        plans.extend(p.children().apply(i) for i in range(p.children().size()))
    return total


def _lineitems(spark, rows):
    sf = shared_dir(spark, "own-lineitem")
    n = F.col("id")
    part = F.pmod(F.xxhash64(n), F.lit(2000))
    price = F.round(900 + F.pmod(F.xxhash64(n, F.lit(1)), F.lit(9_000_000)) / 100, 2)
    (spark.range(0, rows, 1, 2).select(
        F.floor(n / 4).alias("l_orderkey"), part.alias("l_partkey"), (part % 100).alias("l_suppkey"), (n % 4 + 1).cast("int").alias("l_linenumber"),
        (F.when(n % 97 > 0, n % 50 + 1)).cast("double").alias("l_quantity"), price.alias("l_extendedprice"),
        (n % 11 / 100).alias("l_discount"), (n % 9 / 100).alias("l_tax"), F.element_at(F.array(*map(F.lit, "ANR")), (part % 3 + 1).cast("int")).alias("l_returnflag"),
        F.when(part % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(id % 2000))").alias("l_shipdate"))
     .write.parquet(f"{sf}/lineitem.parquet"))
    return sf


def test_csv_strings_needs_little_disk(spark):
    import glob
    import os
    from hubcast.plans import roundtrips
    from hubcast.session import checkpoint_root
    from hubcast.sources import fixtures as fx
    sf = _lineitems(spark, 120_000)
    found = lambda name: set(glob.glob(f"{checkpoint_root(spark)}/hubcast/{name}-*/part-*"))
    kept = lambda files: sum(os.path.getsize(f) for f in files)
    plain = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "plain-csv"))
    text = kept(glob.glob(f"{plain}/part-*"))
    before = found("trips-csv-str")
    got = roundtrips.q_csv_strings(spark, sf)
    files = found("trips-csv-str") - before
    assert kept(files) < text / 2 and len(files) == 4  # two tasks of 60,000 trips, files of 50,000 at most
    rows = spark.read.option("header", True).csv(plain).repartition(4)
    assert 0 < _shuffled_bytes(got) < 0.75 * _shuffled_bytes(rows)
    want = fx.trips(spark, sf).select(*[F.col(c).cast(t).alias(c) for c, t in roundtrips.CANONICAL.items()])
    assert got.dtypes == want.dtypes and got.count() == 120_000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_csv_strings_without_trips(spark):
    from hubcast.plans import roundtrips
    assert roundtrips.q_csv_strings(spark, _lineitems(spark, 0)).collect() == []


def test_spread_gives_back_every_value(spark):
    odd = [None, "", " ", "n", "\u0001", "\u0002", "\u0001n", "\u0001\u0001e", "\u0001s\u0002", "\u0002\u0002", 'a,"b"', "\\", "\r\n\t", "é漢🚕", "0" * 5000]
    rows = [(a, i, b, float(i) if i % 3 else None, odd[i % len(odd)]) for a in odd for i, b in enumerate(odd)]
    df = spark.createDataFrame(rows * 2, "`a.b` string, i int, `c``d` string, x double, last string")
    for frame in (df, df.select("`a.b`", "last"), df.select("`a.b`"), df.select("i", "x"), df.selectExpr("i AS k", "i AS k", "last", "`a.b`")):
        got = io.spread(frame, 7)
        assert got.rdd.getNumPartitions() == 7 and got.dtypes == frame.dtypes
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, frame.collect())))
    parts = io.spread(df, 5).rdd.glom().map(len).collect()
    assert sum(parts) == len(rows) * 2 and max(parts) - min(parts) <= df.rdd.getNumPartitions()
