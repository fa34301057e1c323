"""Fitted pipelines: the single per-response pipeline equals the shared path and
survives save/load."""
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hubcast.ml.pipelines import fit_models
from hubcast.session import shared_dir
from hubcast.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_single_pipeline_per_response(spark):
    trips = fx.trips(spark, SF_SMALL)
    models = fit_models(trips, ("rides", "fpm"))
    one = models.as_pipeline_model("fpm")
    path = shared_dir(spark, "pipeline-fpm")
    one.write().overwrite().save(path)
    again = PipelineModel.load(path)
    keys = ["cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour"]
    a = again.transform(trips).select(*keys, "p_fpm")
    b = models.predict(models.hourly(trips), ["fpm"]).select(*keys, F.col("p_fpm").alias("q"))
    j = a.join(b, keys, "full_outer")
    assert j.where(F.col("p_fpm").isNull() | F.col("q").isNull() | (F.abs(F.col("p_fpm") - F.col("q")) > 1e-9)).count() == 0
    assert j.count() == b.count()


def test_hour_as_category_fits_every_hour_level(spark):
    trips = fx.trips(spark, SF_SMALL)
    models = fit_models(trips, ("rides",), hour_as_category=True)
    scored = models.predict(models.hourly(trips))
    res = scored.agg(F.max(F.abs(F.col("rides") - F.col("p_rides")))).first()[0]
    by_hour = scored.groupBy("pickup_hour").agg(F.abs(F.avg(F.col("rides") - F.col("p_rides"))).alias("m"))
    # With hour as a factor the residuals average to zero within every hour.
    assert by_hour.agg(F.max("m")).first()[0] < 1e-6 * max(res, 1.0)
    assert "pickup_hour_f" not in scored.columns


def test_release_keeps_models_usable(spark):
    trips = fx.trips(spark, SF_SMALL)
    models = fit_models(trips, ("fpm",))
    models.release()
    assert models.training is None
    assert models.predict(models.hourly(trips), ["fpm"]).count() > 0
