"""Further models: weighted / no-intercept regression (M12), GLMs (M13), trees
(M14, M15), random-forest classification with probabilities and importances
(M16, M17), scaling / binarising / normalising (M5–M7), bisecting k-means,
evaluators and cross-validation (M22), single-stage apply (M20)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (Binarizer, Normalizer, RFormula, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   LinearRegression)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """M3: vector assembly."""
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def weighted_lm(df: DataFrame, y: str, x: list[str], weight: str, fit_intercept: bool = False,
                prediction: str = "prediction") -> PipelineModel:
    """Weighted least squares, optionally without intercept."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=x, outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=y, weightCol=weight,
                         fitIntercept=fit_intercept, predictionCol=prediction, regParam=0.0),
    ]).fit(df)


def glm(df: DataFrame, y: str, x: list[str], family: str = "gaussian", link: str | None = None,
        weight: str | None = None, variance_power: float | None = None) -> PipelineModel:
    """Weighted GLM (gaussian, poisson, gamma, tweedie).

    ``gamma`` defaults to the log link here: the canonical inverse link can
    diverge.  Gamma and poisson need ``y > 0`` / ``y >= 0``; rows outside are
    dropped by the caller's filter, not silently here.
    """
    kw = {"family": family, "labelCol": y, "featuresCol": "features", "maxIter": 50, "tol": 1e-8}
    if family == "gamma" and link is None:
        link = "log"
    if link:
        kw["link"] = link
    if weight:
        kw["weightCol"] = weight
    if family == "tweedie" and variance_power is not None:
        kw["variancePower"] = variance_power
    return Pipeline(stages=[VectorAssembler(inputCols=x, outputCol="features"),
                            GeneralizedLinearRegression(**kw)]).fit(df)


def gbt_regression(df: DataFrame, y: str, x: list[str], max_iter: int = 20, seed: int = 42,
                   checkpoint_interval: int = 10) -> PipelineModel:
    """Gradient-boosted trees.

    Boosting builds a long lineage (one step per tree); its intermediate
    predictions are checkpointed every ``checkpoint_interval`` trees into the
    session's shared checkpoint folder, so a lost executor never replays the
    whole chain.
    """
    from hubcast.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return Pipeline(stages=[VectorAssembler(inputCols=x, outputCol="features"),
                            GBTRegressor(labelCol=y, featuresCol="features", maxIter=max_iter,
                                         seed=seed, checkpointInterval=checkpoint_interval)]).fit(df)


def tree_regression(df: DataFrame, y: str, x: list[str], max_depth: int = 5, seed: int = 42) -> PipelineModel:
    """Decision-tree regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=x, outputCol="features"),
                            DecisionTreeRegressor(labelCol=y, featuresCol="features",
                                                  maxDepth=max_depth, seed=seed)]).fit(df)


def forest_classifier(df: DataFrame, label: str, features: list[str], trees: int = 20,
                      seed: int = 42, subset: str = "auto") -> PipelineModel:
    """Random forest on categorical columns through a formula; the label is
    indexed by descending frequency first so class names can be recovered.
    ``subset`` is the share of slots a node looks at (``all`` where few slots matter)."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="frequencyDesc"),
        RFormula(formula=f"label_idx ~ {' + '.join(features)}", featuresCol="features",
                 labelCol="label"),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, seed=seed,
                               featureSubsetStrategy=subset),
    ]).fit(df)


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted class name plus one ``probability_<class>`` column per class."""
    labels = list(model.stages[0].labels)
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(x) for x in labels])
    return out.select("*", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                      *[F.col("_p")[i].alias(f"probability_{lab}") for i, lab in enumerate(labels)]) \
        .drop("_p")


def feature_names(frame: DataFrame, col: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, from its ML attribute metadata."""
    meta = frame.schema[col].metadata.get("ml_attr", {})
    slots = []
    for group in meta.get("attrs", {}).values():
        slots.extend((a["idx"], a.get("name", f"f{a['idx']}")) for a in group)
    return [name for _, name in sorted(slots)] or [f"f{i}" for i in range(meta.get("num_attrs", 0))]


def feature_importances(model: PipelineModel, frame: DataFrame, keep_positive: bool = True) -> DataFrame:
    """Importance per feature (a small table: one row per vector slot)."""
    forest = model.stages[-1]
    imp = forest.featureImportances.toArray().tolist()
    names = feature_names(model.transform(frame.limit(0)))
    names = names if len(names) == len(imp) else [f"f{i}" for i in range(len(imp))]
    df = frame.sparkSession.createDataFrame(list(zip(names, imp)), "feature string, importance double")
    return df.where("importance > 0") if keep_positive else df


def standard_scaler(df: DataFrame, columns: list[str], with_mean: bool = True,
                    with_std: bool = True) -> DataFrame:
    """M5: ``StandardScaler`` on assembled columns."""
    a = assemble(df, columns, "_raw")
    return StandardScaler(inputCol="_raw", outputCol="scaled", withMean=with_mean,
                          withStd=with_std).fit(a).transform(a).drop("_raw")


def binarize(df: DataFrame, col: str, threshold: float, out: str | None = None) -> DataFrame:
    """M6: 1.0 above the threshold, else 0.0."""
    return Binarizer(threshold=threshold, inputCol=col, outputCol=out or f"{col}_bin").transform(df)


def normalize(df: DataFrame, columns: list[str], p: float = 2.0) -> DataFrame:
    """M7: unit p-norm rows."""
    return Normalizer(p=p, inputCol="_raw", outputCol="normalized").transform(
        assemble(df, columns, "_raw")).drop("_raw")


def string_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M7: index strings by descending frequency."""
    return StringIndexer(inputCol=col, outputCol=out or f"{col}_idx",
                         stringOrderType="frequencyDesc").fit(df).transform(df)


def bisecting_kmeans(df: DataFrame, features: str = "features", k: int = 5, seed: int = 42):
    """Fitted bisecting k-means over a vector column."""
    return BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)


def cross_validated_lm(df: DataFrame, y: str, x: list[str], reg_params=(0.0, 0.1), folds: int = 3,
                       seed: int = 42, assembled: str = "features"):
    """K-fold cross-validation of a linear model over a parameter grid."""
    lr = LinearRegression(featuresCol=assembled, labelCol=y)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    cv = CrossValidator(estimator=Pipeline(stages=[VectorAssembler(inputCols=x, outputCol=assembled), lr]),
                        estimatorParamMaps=grid, numFolds=folds, seed=seed,
                        evaluator=RegressionEvaluator(labelCol=y, metricName="rmse"))
    return cv.fit(df)


def apply_stage(model: PipelineModel, index: int, df: DataFrame) -> DataFrame:
    """Apply one fitted stage alone (0-based index)."""
    return model.stages[index].transform(df)
