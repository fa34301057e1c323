"""Unit tests of helpers on small literal inputs."""
import pytest
from pyspark.sql import functions as F

from hubcast.functions import text
from hubcast.operators import grid, rollup, runlog, stats
from hubcast.session import shared_dir
from hubcast.sources import io


def test_file_manifest_titles_and_sizes(spark):
    root = shared_dir(spark, "manifest-test")
    for name in ("yellow_tripdata_2009-01", "yellow_tripdata_2009-02"):
        spark.range(10).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    m = io.file_manifest(spark, root, "csv", "overwrite", out_root="/out").collect()
    assert len(m) >= 2
    assert all(r["file_size"] > 0 and "-" not in r["title"] and r["out_path"].startswith("/out/") for r in m)


def test_ingest_loop_records_failures_and_continues(spark):
    from pyspark.sql import types as T
    root = shared_dir(spark, "ingest-test")
    good = io.write_csv(spark.range(5).selectExpr("id", "id * 2 AS x"), f"{root}/good")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.LongType())])
    res = io.ingest_files(spark, [f"{root}/absent", good], lambda s: f"{root}/out", schema, mode="append")
    assert [r.ok for r in res] == [False, True]
    assert spark.read.parquet(f"{root}/out").count() == 5


def test_log_header_drift_is_normalised(spark):
    a = spark.createDataFrame([("fit", 1.0, 10.0)], "action string, time double, n_rows double")
    b = spark.createDataFrame([("fit", 1.0, 10.0)], "action string, runtime double, n_row double")
    c = spark.createDataFrame([("write", 2.0, 3.0)], "action string, runtime double, filesize double")
    out = runlog.union_logs([a, b, c]).collect()
    assert len(out) == 2
    assert {r["action"]: r["runtime"] for r in out} == {"fit": 1.0, "write": 2.0}


def test_densify_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", None, 7), (None, 1, 9)], "k string, h int, n int")
    got = {(r["k"], r["h"]): r["n"] for r in grid.densify(df, ["k", "h"], {"n": 0}).collect()}
    assert got == {("a", 1): 5, ("a", None): 7, (None, 1): 9, (None, None): 0}


def test_densify_has_no_level_cap(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"), F.lit(1).alias("n"))
    assert grid.densify(df, ["a", "b"], {"n": 0}).agg(F.sum("n")).first()[0] == 12_000


def test_letters_and_colours_for_any_number_of_hubs(spark):
    from hubcast.operators.hubs import decorate_centres
    agg = spark.range(800).selectExpr("CAST(id AS INT) AS cluster", "0.0 AS center_lon", "0.0 AS center_lat", "1000 - id AS size")
    got = {r["cluster"]: (r["taxi_hub"], r["hub_color"]) for r in decorate_centres(agg).collect()}
    assert [got[i][0] for i in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"] and got[9][1] == got[0][1]


def test_percentile_methods_agree_on_nan(spark):
    from hubcast.operators.stats import percentiles
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    got = [[r["value"] for r in percentiles(df, "x", method=m).orderBy("percentile").collect()] for m in ("distributed", "aggregate")]
    assert got == [[1.25, 1.5, 1.75]] * 2


def test_rank_of_large_longs(spark):
    from hubcast.operators.clean import first_appearance_rank
    df = spark.createDataFrame([("c", 2 ** 60 + 3), ("a", 2 ** 60 + 1), ("b", 2 ** 60 + 2)], "v string, at long")
    assert {r["v"]: r["v_rank"] for r in first_appearance_rank(df, "v", "at").collect()} == {"a": 1, "b": 2, "c": 3}


def test_firewall_header_is_checked(spark, tmp_path):
    from hubcast.sources import io
    from hubcast.sources.schemas import FIREWALL_COLUMNS, firewall_schema
    names = [n for n, _ in FIREWALL_COLUMNS]
    for order, ok in ((names, True), (names[::-1], False)):
        path = tmp_path / f"{ok}.csv"
        path.write_text(",".join(order) + "\n" + ",".join("1" if n in ("ident", "SourceIP") else "" for n in order) + "\n")
        read = io.read_csv(spark, str(path), schema=firewall_schema(), check_header=True)
        if ok:
            assert len(names) == 48 and (read.first()["ident"], read.first()["SourceIP"]) == (1.0, "1")
        else:
            with pytest.raises(Exception):
                read.collect()


def test_truncated_file_is_not_lost_in_silence(spark, tmp_path):
    import gzip

    from pyspark.sql import types as T

    from hubcast.sources import io
    schema = T.StructType([T.StructField("x", T.LongType())])
    whole = gzip.compress(("x\n" + "\n".join(str(i * 7919 % 100_003) for i in range(20_000))).encode())
    (tmp_path / "bad.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "good.csv.gz").write_bytes(whole)
    files = [str(tmp_path / "bad.csv.gz"), str(tmp_path / "good.csv.gz")]
    with pytest.raises(Exception):
        io.ingest_one_job(spark, files, str(tmp_path / "out"), schema)
    log = io.ingest_files(spark, files, lambda f: f + ".parquet", schema)
    assert [r.ok for r in log] == [False, True] and spark.read.parquet(files[1] + ".parquet").count() == 20_000


def test_contingency_fills_absent_cells(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("y", "q")], "r string, c string")
    got = {r["r"]: (r["p"], r["q"]) for r in rollup.contingency(df, "r", "c", ["p", "q"]).collect()}
    assert got == {"x": (1, 0), "y": (0, 2)}


def test_share_table_sums_to_one(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"))
    total = rollup.share_table(df, "k").agg(F.sum("percent")).first()[0]
    assert abs(total - 1.0) < 1e-12


def test_correlation_triangle_and_profile_shapes(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                 (F.col("id") % 7).cast("double").alias("c"))
    tri = stats.correlation_triangle(df, ["a", "b", "c"]).collect()
    assert len(tri) == 3
    assert abs({(r[0], r[1]): r[2] for r in tri}[("b", "a")] - 1.0) < 1e-12
    prof = {r["summary"]: r for r in stats.column_profile(df, ["a", "c"]).collect()}
    assert prof["a"]["count"] == 100 and prof["a"]["max"] == 99.0


def test_string_helpers(spark):
    df = spark.createDataFrame([("a-b-c", "/x/y/file.name.csv", "cash")], "s string, p string, pay string")
    r = df.select(text.replace_first("s", "-", "+").alias("r1"), text.remove_all("s", "-").alias("r2"),
                  text.basename_sans_ext("p").alias("b"), text.recode("pay", {"cash": "CSH"}).alias("c"),
                  text.recode("pay", {"x": "y"}, default="other").alias("d"),
                  *text.split_to_columns("s", "-", ["k", "rest"])).first()
    assert (r.r1, r.r2, r.b, r.c, r.d, r.k, r.rest) == ("a+b-c", "abc", "file.name", "CSH", "other", "a", "b-c")


def test_first_per_key_breaks_ties_explicitly(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "a"), (2, 1, "z")], "k int, t int, v string")
    got = {r["k"]: r["v"] for r in rollup.first_per_key(df, "k", ["t", "v"]).collect()}
    assert got == {1: "a", 2: "z"}


def test_correlation_matrix_matches_pairwise(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"),
                                 (F.col("id") * F.col("id")).cast("double").alias("c"))
    a = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    b = {(r[0], r[1]): r[2] for r in stats.correlation_triangle(df, ["a", "b", "c"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_local_table(spark):
    df = io.local_table(spark, [(1, "x")], "k int, v string")
    assert df.collect()[0]["v"] == "x"


def test_csv_and_json_keep_microseconds_and_empty_flags_become_null(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575), "")], "t timestamp_ntz, flag string")
    p = io.write_csv(df, shared_dir(spark, "us-csv"))
    back = io.typed(io.read_csv(spark, p, schema=df.schema), {"flag": "boolean"}).first()
    assert back["t"].microsecond == 179575 and back["flag"] is None
    j = io.write_json(df.select("t"), shared_dir(spark, "us-json"))
    assert io.read_json(spark, j, df.select("t").schema).first()["t"].microsecond == 179575


def test_distributed_row_number_matches_window(spark):
    from pyspark.sql import Window
    from hubcast.operators.ranking import distributed_row_number
    df = spark.range(3000).select((F.col("id") % 97).cast("double").alias("k"), F.col("id").alias("v"))
    a = {r["v"]: r["rank"] for r in distributed_row_number(df, "k", ("v",), buckets=16).collect()}
    w = Window.orderBy("k", "v")
    b = {r["v"]: r["r"] for r in df.select("v", F.row_number().over(w).alias("r")).collect()}
    assert a == b


def test_first_appearance_rank_with_timestamps_and_ties(spark):
    import datetime as dt
    from hubcast.operators.clean import first_appearance_rank
    t0 = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(t0, "b"), (t0, "a"), (t0 + dt.timedelta(hours=1), "c"), (t0, "b")],
                               "t timestamp_ntz, v string")
    got = {r[0]: r[1] for r in first_appearance_rank(df, "v", "t").collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_forest_importances_carry_feature_names(spark):
    from hubcast.ml import models as mm
    rows = [(f"10.0.0.{i % 4}", "HTTP" if i % 3 else "DNS", "Denied" if i % 4 == 0 else "Establish")
            for i in range(200)]
    df = spark.createDataFrame(rows, "SourceIP string, ApplicationProtocol string, Action string")
    model = mm.forest_classifier(df, "Action", ["SourceIP", "ApplicationProtocol"], trees=5)
    imp = mm.feature_importances(model, df, keep_positive=False).collect()
    names = [r["feature"] for r in imp]
    assert any(n.startswith("SourceIP") for n in names)
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    probs = mm.class_probabilities(model, df)
    assert {"probability_Establish", "probability_Denied", "predicted"} <= set(probs.columns)


def test_sample_n_equals_full_sort_on_random_keys(spark):
    from hubcast.operators import sampling
    df = spark.range(20000).repartition(7)
    got = sorted(r[0] for r in sampling.sample_n(df, 300, seed=7).collect())
    want = sorted(r[0] for r in df.withColumn("_u", F.rand(7)).orderBy("_u").limit(300).collect())
    assert got == want and len(set(got)) == 300
    assert sampling.sample_n(df, 50_000).count() == 20000


def test_one_pass_summaries_equal_separate(spark):
    from hubcast.operators.rollup import hourly_rollup
    from hubcast.plans.catalog import rounded
    from hubcast.plans.flagship import clean_hub_trips
    from hubcast.plans.summaries import summaries, summaries_one_pass
    from hubcast.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    raw = fx.raw_trips(spark, SF_SMALL)
    cal = clean_hub_trips(raw)
    a = summaries(raw, cal, hourly_rollup(cal), density_cap=None)
    b = summaries_one_pass(raw, cal, density_cap=None)
    for k in a:
        assert sorted(rounded(a[k]).collect()) == sorted(rounded(b[k].select(*a[k].columns)).collect()), k


def test_hub_profile_single_pass_equals_join_form(spark):
    from hubcast.operators import hubs
    from hubcast.operators.clean import plausible_trips
    from hubcast.plans.catalog import rounded
    from hubcast.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    t = hubs.assign_hubs(plausible_trips(fx.trips(spark, SF_SMALL)))
    a = rounded(hubs.hub_profile(t))
    b = rounded(hubs.hub_profile(t, join=True)).select(*a.columns)
    assert sorted(a.collect()) == sorted(b.collect())
