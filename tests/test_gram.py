"""Least squares from the Gram table: against numpy, with nulls, unknown levels and deficient designs; clustering on points."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from hubcast.ml.gram import Design, fit_gram, gram_table, merge_gram, observed_design, solve_gram
from hubcast.ml.pipelines import fit_clusters
from hubcast.session import shared_dir

ROWS = [(["a", "b", "c", "it's"][i % 4] if i % 13 else None, i % 3, float(i % 7), None if i % 11 == 0 else 3.0 * (i % 3) + i % 5, float(i)) for i in range(200)]
COLUMNS = "f string, g int, x double, y double, z double"


def _numpy(rows, design, at):
    kept = [r for r in rows if r[0] is not None and r[at] is not None]
    x = [[1.0] + [float(r[0] == v) for v in design.factors["f"][:-1]] + [float(r[1] == v) for v in design.factors["g"][:-1]] + [r[2]] for r in kept]
    return np.linalg.lstsq(np.array(x), np.array([r[at] for r in kept]), rcond=None)[0], x, [r[at] for r in kept]


def test_coefficients_figures_and_predictions(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    fit = fit_gram(df, ["y", "z"], ["f", "g"], ["x"])
    assert fit.design.factors["f"] == [v for v, _ in sorted(((v, -sum(r[0] == v for r in ROWS)) for v in ("a", "b", "c", "it's")), key=lambda p: (p[1], p[0]))]
    for name, at in (("y", 3), ("z", 4)):
        beta, x, y = _numpy(ROWS, fit.design, at)
        assert np.allclose(fit.coefficients[name], beta)
        left = np.array(y) - np.array(x) @ beta
        assert fit.summary[name]["n"] == len(y) and np.isclose(fit.summary[name]["rmse"], np.sqrt((left ** 2).mean()))
        assert np.isclose(fit.summary[name]["r2"], 1 - (left ** 2).sum() / ((y - np.mean(y)) ** 2).sum())
    got = fit.predict(df.where("f IS NOT NULL")).collect()
    beta = fit.coefficients["z"]
    for r in got:
        x = [1.0] + [float(r["f"] == v) for v in fit.design.factors["f"][:-1]] + [float(r["g"] == v) for v in fit.design.factors["g"][:-1]] + [r["x"]]
        assert abs(r["p_z"] - np.dot(x, beta)) < 1e-9
    odd = spark.createDataFrame([("new", 1, 1.0), (None, 1, 1.0), ("a", 1, None)], "f string, g int, x double")
    assert [r["p_y"] for r in fit.predict(odd).collect()] == [None] * 3
    assert fit.stage("y").transform(odd).columns == ["f", "g", "x", "p_y"]


def test_tables_of_parts_add_up(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    design = observed_design(df, ["f", "g"], ["x"])
    parts = [gram_table(df.where(w), design, ["y"]) for w in ("z < 50", "z >= 50 AND z < 51", "z >= 51", "false")]
    whole = fit_gram(df, ["y"], ["f", "g"], ["x"])
    assert np.allclose(solve_gram(merge_gram(*parts), design, ["y"]).coefficients["y"], whole.coefficients["y"])


def test_deficient_designs_and_responses_without_rows(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).withColumns({"x2": F.col("x") * 2, "none": F.lit(None).cast("double")})
    fit = fit_gram(df, ["z", "none"], ["f"], ["x", "x2"])
    assert fit.coefficients["none"] is None and fit.predict(df).agg(F.count("p_none")).first()[0] == 0
    plain = fit_gram(df, ["z"], ["f"], ["x"])
    gap = plain.predict(fit.predict(df, ["z"]).withColumnRenamed("p_z", "q_z")).agg(F.max(F.abs(F.col("p_z") - F.col("q_z")))).first()[0]
    assert gap < 1e-8 and "std_errors" not in fit.summary["z"]
    with pytest.raises(ValueError):
        observed_design(df, ["z"], [], max_slots=50)
    assert fit_gram(df.limit(0), ["z"], ["f"], ["x"], Design({"f": ["a", "b"]}, ["x"])).coefficients["z"] is None


def test_clusters_are_fitted_on_the_two_columns(spark):
    trips = spark.range(4000).select(*[F.lit(v).alias(c) for c, v in (("passenger_count", 1.0), ("trip_distance", 2.0), ("total_amt", 3.0))],
                                     (F.lit(-73.9) + F.col("id") % 2 / 10).alias("start_lon"), F.lit(40.7).alias("start_lat"),
                                     F.lit(-73.9).alias("end_lon"), F.lit(40.7).alias("end_lat"), F.lit("2020-01-01").cast("timestamp").alias("trip_pickup_datetime"))
    from hubcast.ml.pipelines import KMeansParams
    model = fit_clusters(trips, KMeansParams(k=2))
    assert sorted(round(float(c[1]), 6) for c in model.stages[-1].clusterCenters()) == [-73.9, -73.8]
    path = shared_dir(spark, "clusters")
    model.write().overwrite().save(path)
    assert model.transform(trips).groupBy("cluster").count().count() == 2
