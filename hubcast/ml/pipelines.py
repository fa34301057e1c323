"""Clean → cluster → hourly rollup → encode → regress, as Spark ML pipelines.

Clustering is fitted once and shared by every response model (the original
refits it per response).  The two query stages are ``SQLTransformer``s, so a
saved pipeline carries its SQL, and Catalyst still pushes the clean filter
into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, RFormula, SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubcast.ml.gram import LinearFit, fit_gram
from hubcast.operators.clean import DEFAULT_BOUNDS, TripBounds
from hubcast.session import cut_lineage, spread_for_iteration


def clean_statement(b: TripBounds = DEFAULT_BOUNDS) -> str:
    """M1: the plausibility filter (P2) as a query over ``__THIS__``."""
    return (
        "SELECT * FROM __THIS__ WHERE "
        f"start_lon > {b.lon_min!r} AND start_lon < {b.lon_max!r} AND "
        f"start_lat > {b.lat_min!r} AND start_lat < {b.lat_max!r} AND "
        f"end_lon > {b.lon_min!r} AND end_lon < {b.lon_max!r} AND "
        f"end_lat > {b.lat_min!r} AND end_lat < {b.lat_max!r} AND "
        f"passenger_count > {b.passengers_min!r} AND passenger_count < {b.passengers_max!r} AND "
        f"trip_distance > {b.distance_min!r} AND trip_distance < {b.distance_max!r} AND "
        f"total_amt > {b.total_min!r} AND trip_pickup_datetime IS NOT NULL"
    )


#: The trip columns that the stages of a response pipeline (clean, cluster, rollup) name.
PIPELINE_COLUMNS = ("start_lat", "start_lon", "end_lat", "end_lon", "passenger_count", "trip_distance", "total_amt",
                    "trip_pickup_datetime", "fare_amt", "tip_amt")

# Trips are grouped by numbers; the text keys are made once an hour's row, not once a trip (2023-01-01 was a Sunday, day 1).
ROLLUP_STATEMENT = """
SELECT cluster,
       date_format(make_date(y, m, 1), 'yyyy') AS pickup_year, date_format(make_date(y, m, 1), 'MM') AS pickup_mon,
       date_format(date_add(DATE'2023-01-01', pickup_nday - 1), 'E') AS pickup_wday, pickup_nday, pickup_hour,
       rides, passengers, distance, fare, tip,
       try_divide(passengers, rides) AS ppr, try_divide(distance, rides) AS dpr,
       try_divide(fare, rides) AS fpr, try_divide(tip, rides) AS tpr,
       try_divide(fare, distance) AS fpm, try_divide(tip, distance) AS tpm
FROM (
  SELECT cluster, year(trip_pickup_datetime) AS y, month(trip_pickup_datetime) AS m,
         CAST(dayofweek(trip_pickup_datetime) AS INT) AS pickup_nday,
         CAST(hour(trip_pickup_datetime) AS INT) AS pickup_hour,
         count(1) AS rides, sum(passenger_count) AS passengers, sum(trip_distance) AS distance,
         sum(fare_amt) AS fare, sum(tip_amt) AS tip
  FROM __THIS__
  GROUP BY 1, 2, 3, 4, 5
)
"""


@dataclass
class KMeansParams:
    """K-means settings of the original hub clustering."""
    k: int = 5
    seed: int = 42
    max_iter: int = 20
    tol: float = 1e-4
    init_steps: int = 2
    init_mode: str = "k-means||"
    features: tuple = ("start_lat", "start_lon")
    prediction_col: str = "cluster"


def cluster_pipeline(params: KMeansParams = KMeansParams(), bounds: TripBounds = DEFAULT_BOUNDS,
                     use_formula: bool = True) -> Pipeline:
    """M1 + M2/M3 + M8: clean, assemble lat/lon, k-means."""
    feats = list(params.features)
    assemble = (RFormula(formula="~ " + " + ".join(feats), featuresCol="features") if use_formula
                else VectorAssembler(inputCols=feats, outputCol="features"))
    km = KMeans(k=params.k, seed=params.seed, maxIter=params.max_iter, tol=params.tol,
                initSteps=params.init_steps, initMode=params.init_mode,
                featuresCol="features", predictionCol=params.prediction_col)
    return Pipeline(stages=[SQLTransformer(statement=clean_statement(bounds)), assemble, km])


def to_formula(response: str, features: list[str]) -> str:
    """``y ~ a + b`` from names."""
    return f"{response} ~ {' + '.join(features)}"


DEFAULT_FEATURES = ["en_cluster", "pickup_wday", "pickup_hour"]


def regression_pipeline(response: str, features: list[str] = DEFAULT_FEATURES,
                        hour_as_category: bool = False) -> Pipeline:
    """M4 + M2 + M11: one-hot the hub id (drop last), formula, linear regression.

    ``pickup_hour`` enters as a number by default (as in the original model); pass
    ``hour_as_category=True`` to encode it as a factor.
    """
    stages = [OneHotEncoder(inputCols=["cluster"], outputCols=["en_cluster"], dropLast=True)]
    feats = list(features)
    if hour_as_category:
        stages.append(SQLTransformer(
            statement="SELECT *, CAST(pickup_hour AS STRING) AS pickup_hour_f FROM __THIS__"))
        feats = ["pickup_hour_f" if f == "pickup_hour" else f for f in feats]
    stages += [RFormula(formula=to_formula(response, feats), featuresCol="features_" + response,
                        labelCol="label_" + response, handleInvalid="error"),
               LinearRegression(featuresCol="features_" + response, labelCol="label_" + response,
                                predictionCol=f"p_{response}", solver="auto")]
    return Pipeline(stages=stages)


def rollup_transformer() -> SQLTransformer:
    """M1: the hourly rollup with unit rates (A2 + A3) as a pipeline stage."""
    return SQLTransformer(statement=ROLLUP_STATEMENT)


def feature_pipeline(features: list[str] = DEFAULT_FEATURES, hour_as_category: bool = False) -> Pipeline:
    """M4 + M2 (one-sided): one-hot hub id (drop last), then a label-free formula
    that indexes strings by descending frequency, one-hots them (drop last) and
    assembles the vector.  Fitted once and shared by every response model.
    ``pickup_hour`` is numeric by default; ``hour_as_category=True`` encodes it
    as a factor (24 levels, drop last)."""
    stages = [OneHotEncoder(inputCols=["cluster"], outputCols=["en_cluster"], dropLast=True)]
    feats = list(features)
    if hour_as_category:
        stages.append(SQLTransformer(
            statement="SELECT *, lpad(CAST(pickup_hour AS STRING), 2, '0') AS pickup_hour_f FROM __THIS__"))
        feats = ["pickup_hour_f" if f == "pickup_hour" else f for f in feats]
    stages.append(RFormula(formula="~ " + " + ".join(feats), featuresCol="features_x", handleInvalid="error"))
    return Pipeline(stages=stages)


@dataclass
class FittedModels:
    """Fitted clustering, shared feature encoding and one linear model per response.

    Models solved from the Gram table are SQL stages over the plain columns, so
    their encoding has no stages; ``fit`` holds their coefficients and summary."""
    cluster: PipelineModel
    features: PipelineModel | None = None
    regressions: dict = field(default_factory=dict)
    fit: LinearFit | None = None
    training: DataFrame | None = None  # encoded hourly table used for the fits
    cached: DataFrame | None = None    # the cached hourly table under it

    def release(self) -> None:
        """Drop the cached hourly table (the fitted models stay usable)."""
        if self.cached is not None:
            self.cached.unpersist()
        self.training = self.cached = None

    def assign(self, trips: DataFrame) -> DataFrame:
        """Clean + hub assignment (row-level stages only; usable on streams)."""
        return self.cluster.transform(trips)

    def hourly(self, trips: DataFrame) -> DataFrame:
        return rollup_transformer().transform(self.assign(trips))

    def as_pipeline_model(self, response: str) -> PipelineModel:
        """One fitted pipeline for one response, raw trips in, hourly predictions
        out (clean → cluster → rollup → encode → regress), built from the shared
        fitted stages; it can be saved and reloaded as a single model."""
        return PipelineModel(stages=[*self.cluster.stages, rollup_transformer(), *self.features.stages,
                                     self.regressions[response]])

    def predict(self, frame: DataFrame, responses: list[str] | None = None) -> DataFrame:
        """Encode once, then every response model adds ``p_<response>``."""
        out = self.features.transform(frame)
        for r in responses or list(self.regressions):
            out = self.regressions[r].transform(out)
        return out.drop("features_x", "en_cluster", "pickup_hour_f")


def fit_clusters(trips: DataFrame, params: KMeansParams = KMeansParams(), fraction: float = 1.0, partitions: int | None = None,
                 collapse: bool = True) -> PipelineModel:
    """M8 on the columns it needs: trips are cleaned and cut to the features *before* anything is shuffled.

    ``collapse`` fits on the distinct points weighted by their trips (the same
    objective): trips are counted per point map-side, so a place that holds a
    third of all trips is one row.  Without it every trip is a row of the fit.
    """
    whole = cluster_pipeline(params)
    clean, *rest = whole.getStages()
    feats = list(params.features)
    fit_input = trips if fraction >= 1.0 else trips.sample(False, fraction, params.seed)
    points = clean.transform(fit_input).select(*feats)
    if collapse:
        points = points.groupBy(*feats).agg(F.count(F.lit(1)).cast("double").alias("trips"))
        rest[-1] = rest[-1].copy({rest[-1].weightCol: "trips"})
    if partitions is None:   # the points are counted first: written once, not made twice
        points = cut_lineage(points)
    fitted = Pipeline(stages=rest).fit(spread_for_iteration(points, partitions))
    return PipelineModel(stages=[clean, *fitted.stages])


def fit_models(trips: DataFrame, responses=("rides", "fpm"), params: KMeansParams = KMeansParams(),
               features: list[str] = DEFAULT_FEATURES, persist_hourly: bool = True,
               cluster_fraction: float = 1.0, hour_as_category: bool = False, cluster_partitions: int | None = None,
               solver: str = "gram", collapse: bool = True) -> FittedModels:
    """Fit clustering once, roll up once, fit one linear regression per response.

    The hourly table (one row per hub × year × month × weekday × hour) is small
    relative to the trips and is cached for the fits.

    ``solver="gram"`` (default) solves all responses from one aggregate over the
    hourly table (``hubcast.ml.gram``).  ``solver="ml"`` encodes the table once
    and fits a ``LinearRegression`` per response; both have the same predictions.

    ``cluster_fraction < 1`` fits the k centres on a seeded Bernoulli sample
    (k-means caches and rescans its input every iteration; five 2-D centres do
    not need every trip).  All trips are still assigned and rolled up.
    """
    km = fit_clusters(trips, params, cluster_fraction, cluster_partitions, collapse)
    hourly = rollup_transformer().transform(km.transform(trips))
    if persist_hourly:  # the fits below read it
        hourly = hourly.persist()
    cached = hourly if persist_hourly else None
    if solver == "gram":
        columns = ["cluster" if f == "en_cluster" else f for f in features]
        texts = {c for c, kind in hourly.dtypes if kind == "string"} | {"cluster"} | ({"pickup_hour"} if hour_as_category else set())
        fit = fit_gram(hourly, list(responses), [c for c in columns if c in texts], [c for c in columns if c not in texts]) if responses else None
        return FittedModels(cluster=km, features=PipelineModel(stages=[]), regressions={r: fit.stage(r) for r in responses}, fit=fit,
                            training=cached, cached=cached)
    feats = feature_pipeline(features, hour_as_category).fit(hourly)
    encoded = feats.transform(hourly)
    regs = {r: LinearRegression(featuresCol="features_x", labelCol=r, predictionCol=f"p_{r}",
                                solver="auto").fit(encoded.where(f"{r} IS NOT NULL"))
            for r in responses}
    return FittedModels(cluster=km, features=feats, regressions=regs,
                        training=encoded if persist_hourly else None, cached=cached)


def cluster_summary(models: FittedModels, trips: DataFrame) -> DataFrame:
    """Centre and size per cluster.  A reloaded model has no training
    summary, so sizes are recomputed by assigning the trips (one aggregation);
    the k centres come from the model (k rows)."""
    km = models.cluster.stages[-1]
    spark = trips.sparkSession
    feats = list(KMeansParams().features)
    centres = spark.createDataFrame(
        [(i, *map(float, c)) for i, c in enumerate(km.clusterCenters())],
        ["cluster"] + [f"center_{f}" for f in feats])
    sizes = models.assign(trips).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return centres.join(sizes, "cluster", "left").fillna(0, subset=["size"])


def response_pipeline(response: str, params: KMeansParams = KMeansParams()) -> Pipeline:
    """K7: the whole unfitted pipeline of one response, raw trips in (clean → cluster → rollup → encode → regress)."""
    return Pipeline(stages=[*cluster_pipeline(params).getStages(), rollup_transformer(),
                            *regression_pipeline(response).getStages()])


def save_pipelines(path: str, responses) -> None:
    """K7: save the unfitted pipeline of every response (overwrite)."""
    for r in responses:
        response_pipeline(r).write().overwrite().save(f"{path}/pipeline_{r}")


def load_pipelines(path: str, responses) -> dict[str, Pipeline]:
    """K7: load the pipelines saved by :func:`save_pipelines`, ready to fit."""
    return {r: Pipeline.load(f"{path}/pipeline_{r}") for r in responses}


def save_models(models: FittedModels, path: str) -> None:
    """K7: save the fitted stages (overwrite)."""
    models.cluster.write().overwrite().save(f"{path}/cluster")
    models.features.write().overwrite().save(f"{path}/features")
    for r, m in models.regressions.items():
        PipelineModel(stages=[m]).write().overwrite().save(f"{path}/model_{r}")


def load_models(path: str, responses) -> FittedModels:
    """K7: load the stages saved by :func:`save_models`."""
    return FittedModels(cluster=PipelineModel.load(f"{path}/cluster"),
                        features=PipelineModel.load(f"{path}/features"),
                        regressions={r: PipelineModel.load(f"{path}/model_{r}").stages[0] for r in responses})
