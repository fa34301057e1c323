"""Invariant queries for randomised and iterative operators (sampling, k-means,
regressions, GLMs, trees, forests, save/load).  Each returns one row of
booleans / counts computed by Spark over the whole input; the oracle is the
constant row a correct implementation must produce."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.functions.numeric import tie_round
from hubcast.ml import hashed
from hubcast.ml import models as mm
from hubcast.ml.gram import Design, fit_gram, gram_table, merge_gram, solve_gram
from hubcast.ml.pipelines import (PIPELINE_COLUMNS, FittedModels, KMeansParams, clean_statement, cluster_summary, fit_clusters,
                                  fit_models, load_models, load_pipelines, save_models, save_pipelines)
from hubcast.operators import sampling
from hubcast.operators.clean import plausible_trips
from hubcast.operators.grid import hub_week_hour_grid
from hubcast.operators.hubs import nearest_hub
from hubcast.session import cut_lineage, shared_dir
from hubcast.sources import fixtures as fx
from hubcast.sources import io

TOL = 1e-6


def row_hash(df: DataFrame, cols: list[str] | None = None) -> F.Column:
    """64-bit hash of whole rows (the trips have no unique key: the source has
    repeated order lines, so rows are compared as multisets)."""
    return F.xxhash64(*[F.col(c) for c in (cols or df.columns)])


def multiset_mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> F.Column:
    """Number of key combinations whose multiplicities differ between two frames
    (scalar subquery; two partial aggregates and one shuffle join)."""
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, keys, "full_outer")
    return j.agg(F.count_if(F.coalesce(F.col("_na"), F.lit(0)) != F.coalesce(F.col("_nb"), F.lit(0)))).scalar()


def _clean(spark, sf):
    return plausible_trips(fx.trips(spark, sf))


def q_dev_sample_check(spark: SparkSession, sf: str) -> DataFrame:
    """The sample is written as Parquet and CSV; both copies hold the
    same rows, at most ``cap`` of them, each drawn from the input no more often
    than it occurs there."""
    src = _clean(spark, sf)
    src = src.withColumn("_h", row_hash(src))
    cap = 1000
    paths = sampling.write_development_sample(src.select("_h", "trip_id", "fare_amt"),
                                              shared_dir(spark, "dev-sample"), fraction=0.5, cap=cap)
    s = spark.read.parquet(paths["parquet"])
    c = spark.read.schema(s.schema).option("header", True).csv(paths["csv"])
    cs = s.groupBy("_h").agg(F.count(F.lit(1)).alias("k"))
    cx = src.groupBy("_h").agg(F.count(F.lit(1)).alias("m"))
    excess = cs.join(cx, "_h", "left").agg(F.count_if(F.col("m").isNull() | (F.col("k") > F.col("m")))).scalar()
    copies_differ = multiset_mismatches(s, c, ["_h", "trip_id", "fare_amt"])
    return s.agg((F.count(F.lit(1)) <= cap).alias("within_cap"), (excess + copies_differ).alias("missing"),
                 (F.count(F.lit(1)) == F.lit(cap)).alias("cap_reached"))


def q_random_split_check(spark, sf):
    """Random parts are disjoint and add up to the whole (as multisets)."""
    src = _clean(spark, sf)
    src = src.select(row_hash(src).alias("_h"))
    parts = sampling.random_split(src, {"train": 0.6, "valid": 0.3, "test": 0.1}, seed=42)
    labelled = reduce(lambda a, b: a.unionByName(b),
                      [df.withColumn("part", F.lit(name)) for name, df in parts.items()])
    total = src.agg(F.count(F.lit(1))).scalar()
    return labelled.agg((F.count(F.lit(1)) == total).alias("parts_sum_to_whole"),
                        multiset_mismatches(labelled.select("_h"), src, ["_h"]).alias("overlap"))


def _fitted(spark, sf, responses=("rides", "fpm"), **how) -> tuple[FittedModels, DataFrame]:
    trips = fx.trips(spark, sf)
    models = fit_models(trips, responses, **how)
    return models, trips


def q_kmeans_check(spark, sf):
    """Every trip sits at its nearest fitted centre, every centre at
    the mean of its trips (up to the last step's move); sizes add up."""
    models, trips = _fitted(spark, sf, responses=(), collapse=False)  # every trip a row of the fit, as the sizes count them
    km = models.cluster.stages[-1]
    centres = [(float(c[1]), float(c[0])) for c in km.clusterCenters()]  # features are (lat, lon)
    pred = models.assign(trips)
    sizes = sum(km.summary.clusterSizes)
    means = pred.groupBy("cluster").agg(F.avg("start_lon").alias("x"), F.avg("start_lat").alias("y"))
    at = [F.element_at(F.array(*[F.lit(c[axis]) for c in centres]), F.col("cluster") + 1) for axis in (0, 1)]
    drift = means.agg(F.max(F.greatest(F.abs(F.col("x") - at[0]), F.abs(F.col("y") - at[1])))).scalar()
    return pred.agg(
        (drift <= 0.01).alias("centres_ok"),
        F.count_if(F.col("cluster") != nearest_hub("start_lon", "start_lat", centres)).alias("misassigned"),
        (F.count(F.lit(1)) == F.lit(sizes)).alias("sizes_ok"),
        F.count_distinct("cluster").alias("k_found"))


def q_linreg_check(spark, sf):
    """Rides and fpm regressions on the shared hourly table;
    residual means vanish overall, per hub and per weekday."""
    models, trips = _fitted(spark, sf, solver="ml")
    hourly = models.hourly(trips)
    scored = models.predict(hourly)
    out = []
    for r in ("rides", "fpm"):
        res = F.col(r) - F.col(f"p_{r}")
        scale = scored.agg(F.avg(F.abs(F.col(r)))).scalar()
        worst = [scored.agg(F.abs(F.avg(res)).alias("m"))]
        # with the means per hub and weekday, the last normal equation: the coefficients are the least-squares ones
        worst.append(scored.agg((F.abs(F.avg(res * F.col("pickup_hour"))) / 24).alias("m")))
        for g in ("cluster", "pickup_wday"):
            worst.append(scored.groupBy(g).agg(F.abs(F.avg(res)).alias("m")).agg(F.max("m").alias("m")))
        biggest = reduce(lambda a, b: a.unionByName(b), worst).agg(F.max("m")).scalar()
        out.append((biggest <= F.lit(TOL) * scale).alias(f"{r}_residuals_ok"))
    stage = trips
    for i in range(len(models.cluster.stages)):  # M20: fitted stages applied one at a time
        stage = mm.apply_stage(models.cluster, i, stage)
    keys = ["_h", "cluster"]
    diff = multiset_mismatches(stage.select(row_hash(trips).alias("_h"), "cluster"),
                               models.assign(trips).select(row_hash(trips).alias("_h"), "cluster"), keys)
    # 4 hubs + 6 weekdays + hour: one level of each factor is dropped, so the design has full rank
    slots = models.features.transform(hourly).agg(F.max(F.size(vector_to_array("features_x")))).scalar()
    return spark.range(1).select(*out, (diff == 0).alias("stagewise_equal"), (slots == 11).alias("slots_ok"))


def q_glm_check(spark, sf):
    """Score equations of weighted and generalised linear models hold."""
    cells = (_clean(spark, sf)
             .groupBy(F.round("start_lon", 2).alias("lon"), F.round("start_lat", 2).alias("lat"))
             .agg(F.avg("fare_amt").alias("fare"), F.count(F.lit(1)).cast("double").alias("w"),
                  F.avg("trip_distance").alias("dist")))
    cells = cells.withColumns({"x1": F.col("lon") + 74.0, "x2": F.col("lat") - 40.7}).persist()
    # Weighted, no intercept → Σ w·x_j·r = 0 for each predictor.
    wl = mm.weighted_lm(cells, "fare", ["x1", "x2"], "w", fit_intercept=False).transform(cells)
    r = F.col("fare") - F.col("prediction")
    scale = cells.agg(F.sum(F.col("w") * F.abs("fare"))).scalar()
    wls_ok = wl.agg(F.greatest(F.abs(F.sum(F.col("w") * F.col("x1") * r)),
                               F.abs(F.sum(F.col("w") * F.col("x2") * r)))).scalar() <= F.lit(1e-6) * scale
    checks = [wls_ok.alias("wls_ok")]
    # Canonical-link families → Σ w·(y − μ) = 0 (intercept score equation).
    for fam, link in (("gaussian", None), ("poisson", "log"), ("tweedie", None)):
        kw = {"variance_power": 1.0} if fam == "tweedie" else {}
        g = mm.glm(cells, "fare", ["x1", "x2", "dist"], fam, link, weight="w", **kw).transform(cells)
        dev = g.agg(F.abs(F.sum(F.col("w") * (F.col("fare") - F.col("prediction"))))).scalar()
        checks.append((dev <= F.lit(1e-5) * scale).alias(f"{fam}_ok"))
    # Gamma with log link: Σ w·(y − μ)/μ = 0.
    g = mm.glm(cells.where("fare > 0"), "fare", ["x1", "x2", "dist"], "gamma", "log", weight="w") \
        .transform(cells.where("fare > 0"))
    dev = g.agg(F.abs(F.sum(F.col("w") * (F.col("fare") - F.col("prediction")) / F.col("prediction")))).scalar()
    wsum = cells.agg(F.sum("w")).scalar()
    checks.append((dev <= F.lit(1e-5) * wsum).alias("gamma_ok"))
    return spark.range(1).select(*checks)


def q_tree_check(spark, sf):
    """Boosted trees and a single tree leave less than half of the variance
    of the total, which the fare explains (place and distance explain no fare here)."""
    t = _clean(spark, sf).select("total_amt", "fare_amt", "start_lat", "start_lon", "trip_distance")
    inputs = ["fare_amt", "start_lat", "start_lon", "trip_distance"]
    sd = t.agg(F.stddev_pop("total_amt")).scalar()
    out = []
    for name, model in (("gbt", mm.gbt_regression(t, "total_amt", inputs, 10)),
                        ("tree", mm.tree_regression(t, "total_amt", inputs))):
        rmse = model.transform(t).agg(F.sqrt(F.avg((F.col("total_amt") - F.col("prediction")) ** 2))).scalar()
        out.append((rmse * rmse <= sd * sd / 2).alias(f"{name}_ok"))
    return spark.range(1).select(*out)


FIREWALL_FEATURES = ["SourceIP", "DestinationIP", "OriginalClientIP", "rule", "ApplicationProtocol"]


def q_forest_check(spark, sf):
    """Class probabilities sum to 1, the arg-max is the prediction, importances sum to 1; the result
    code, which tells failures, is found: failures are predicted as such (no constant forest does) and it has most
    of the importance."""
    fw = fx.firewall(spark, sf)
    inputs = [*FIREWALL_FEATURES, "resultcode"]
    model = mm.forest_classifier(fw, "Action", inputs, trees=10, subset="all")
    probs = mm.class_probabilities(model, fw)
    p = vector_to_array("probability")
    top = F.array_position(p, F.array_max(p)) - 1
    imp = mm.feature_importances(model, fw, keep_positive=False)
    imp_sum = imp.agg(F.sum("importance")).scalar()
    told = imp.where(F.col("feature").startswith("resultcode")).agg(F.sum("importance")).scalar()
    pcols = [c for c in probs.columns if c.startswith("probability_")]
    failed = F.col("Action") == "Failed"
    return probs.agg(
        (F.max(F.abs(reduce(lambda a, b: a + b, [F.col(c) for c in pcols]) - 1)) <= 1e-9).alias("probs_sum_to_1"),
        F.count_if(top.cast("double") != F.col("prediction")).alias("argmax_mismatch"),
        (F.abs(imp_sum - 1) <= 1e-9).alias("importances_sum_to_1"),
        (F.count_if(failed & (F.col("predicted") == "Failed")) >= 0.95 * F.count_if(failed)).alias("failures_found"),
        (told > 0.5).alias("importance_found"))


def q_hashed_check(spark, sf):
    """M9 / M16 on hashed columns, every user an address of its own: rows sit at their nearest centre, sizes add
    up, and a forest on hashed columns finds the failures."""
    fw = fx.firewall(spark, sf).withColumn("Address", F.concat(F.lit("10."), F.col("sessionid").cast("long").cast("string")))
    width = 512
    model = hashed.hashed_kmeans(["Address", "DestinationIP", "rule"], k=4, width=width).fit(fw)
    km = model.stages[-1]
    pred = model.transform(fw).withColumn("d", hashed.squared_distances("features", km.clusterCenters()))
    forest = hashed.hashed_forest("Action", ["Address", "rule", "resultcode"], trees=5, width=64, subset="all").fit(fw)
    seen = mm.class_probabilities(forest, fw)
    failed = F.col("Action") == "Failed"
    found = seen.agg(F.count_if(failed & (F.col("predicted") == "Failed")) >= 0.95 * F.count_if(failed)).scalar()
    return pred.agg(F.count_if(F.element_at("d", F.col("cluster") + 1) > F.array_min("d") + 1e-9).alias("misassigned"),
                    (F.count(F.lit(1)) == F.lit(sum(km.summary.clusterSizes))).alias("sizes_ok"), found.alias("failures_found"))


def q_model_reload_check(spark, sf):
    """K7: predictions of saved-and-reloaded pipelines equal the originals."""
    models, trips = _fitted(spark, sf, collapse=False)
    path = shared_dir(spark, "models")
    save_models(models, path)
    again = load_models(path, list(models.regressions))
    hourly = models.hourly(trips)
    a = models.predict(hourly).select("cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour",
                                      "p_rides", "p_fpm")
    b = again.predict(again.hourly(trips)).select("cluster", "pickup_year", "pickup_mon", "pickup_nday",
                                                  "pickup_hour", F.col("p_rides").alias("q_rides"),
                                                  F.col("p_fpm").alias("q_fpm"))
    keys = ["cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour"]
    j = a.join(b, keys, "full_outer")
    # The reloaded model lost its training summary; sizes recomputed by transform.
    trained = sorted(models.cluster.stages[-1].summary.clusterSizes)
    sizes = cluster_summary(again, trips).select(F.sort_array(F.collect_list("size")).alias("s"))
    sizes_equal = sizes.select(F.col("s") == F.array(*[F.lit(int(x)).cast("long") for x in trained])).scalar()
    return j.agg(F.count_if(F.col("p_rides").isNull() | F.col("q_rides").isNull()
                            | (F.col("p_rides") != F.col("q_rides"))
                            | (F.col("p_fpm") != F.col("q_fpm"))).alias("mismatches"),
                 sizes_equal.alias("sizes_equal"))


def q_pipeline_refit_check(spark, sf):
    """K7: unfitted pipelines saved per response, loaded and fitted, predict what
    ``fit_models`` predicts."""
    models, trips = _fitted(spark, sf, collapse=False, cluster_partitions=32)
    path = shared_dir(spark, "pipelines")
    save_pipelines(path, list(models.regressions))
    feats = KMeansParams().features  # the layout fit_models clusters on
    # dealt, sorted and kept once, with the columns that the stages name: a pipeline reads its input some four times
    clean = SQLTransformer(statement=clean_statement()).transform(trips).select(*PIPELINE_COLUMNS)
    spread = clean.repartition(32, *feats).sortWithinPartitions(*feats).persist()
    keys = ["cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour"]
    both = models.predict(models.hourly(trips)).select(*keys, "p_rides", "p_fpm")
    bad = F.lit(False)
    for r, pipeline in load_pipelines(path, list(models.regressions)).items():
        again = pipeline.fit(spread).transform(trips).select(*keys, F.col(f"p_{r}").alias(f"q_{r}"))
        both = both.join(again, keys, "full_outer")
        gap = F.abs(F.col(f"p_{r}") - F.col(f"q_{r}"))
        bad = bad | F.coalesce(gap > 1e-6 * (1 + F.abs(f"p_{r}")), F.lit(True))
    spread.unpersist()  # the fitted pipelines read the trips themselves
    return both.agg(F.count_if(bad).alias("mismatches"))


def q_scaler_check(spark, sf):
    """M5 / M6 / M7: ML feature stages agree with their SQL twins."""
    t = _clean(spark, sf).select("trip_id", "trip_distance", "fare_amt", "payment_type")
    z = mm.standard_scaler(t, ["trip_distance", "fare_amt"]).withColumn("s", vector_to_array("scaled"))
    stats = t.agg(F.avg("trip_distance").alias("m1"), F.stddev_samp("trip_distance").alias("s1"),
                  F.avg("fare_amt").alias("m2"), F.stddev_samp("fare_amt").alias("s2"))
    m1, s1, m2, s2 = (stats.select(c).scalar() for c in ("m1", "s1", "m2", "s2"))
    # Same row, two computations: the ML stage and its SQL twin.
    scale_diff = z.agg(F.max(F.greatest(F.abs(F.col("s")[0] - (F.col("trip_distance") - m1) / s1),
                                        F.abs(F.col("s")[1] - (F.col("fare_amt") - m2) / s2)))).scalar()
    b = mm.binarize(t, "fare_amt", 10.0)
    bin_bad = b.agg(F.count_if(F.col("fare_amt_bin") != (F.col("fare_amt") > 10.0).cast("double"))).scalar()
    n = mm.normalize(t, ["trip_distance", "fare_amt"]).withColumn("v", vector_to_array("normalized"))
    norm_bad = n.agg(F.max(F.abs(F.sqrt(F.col("v")[0] ** 2 + F.col("v")[1] ** 2) - 1))).scalar()
    idx = mm.string_index(t, "payment_type")
    most = t.groupBy("payment_type").count().orderBy(F.desc("count"), "payment_type").limit(1) \
        .select("payment_type").scalar()
    top_idx = idx.where(F.col("payment_type") == most).agg(F.max("payment_type_idx")).scalar()
    return spark.range(1).select((scale_diff <= 1e-9).alias("scaler_ok"), (bin_bad == 0).alias("binarizer_ok"),
                                 (norm_bad <= 1e-9).alias("normalizer_ok"), (top_idx == 0).alias("indexer_ok"))


def q_embedding_clusters_check(spark, sf):
    """Bisecting k-means on the embedding vectors (sizes add up, k clusters, a
    smaller sum of squares than one cluster has) and a cross-validated linear model,
    which finds a known linear form of all components and picks no penalty."""
    e = fx.table(spark, sf, "embeddings")
    form = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i % 5 - 2)), F.lit(0.0), lambda a, x: a + x)
    v = e.select("vec_id", array_to_vector("embedding").alias("features"), form.alias("label"))
    bk = mm.bisecting_kmeans(v, k=4)
    pred = bk.transform(v)
    # one input per component, all of them
    cv = mm.cross_validated_lm(v.select("label", "features"), "label", ["features"], folds=3, assembled="inputs")
    best = min(cv.avgMetrics)
    spread = v.agg(F.stddev_pop("label")).scalar()
    cost = bk.summary.trainingCost
    around = v.select(vector_to_array("features").alias("a")).select(F.posexplode("a").alias("i", "x")).groupBy("i").agg(
        (F.var_pop("x") * F.count(F.lit(1))).alias("s")).agg(F.sum("s")).scalar()
    return pred.agg((F.count(F.lit(1)) == F.lit(sum(bk.summary.clusterSizes))).alias("sizes_ok"),
                    (F.count_distinct("cluster") == 4).alias("k_ok"), (F.lit(cost) < 0.999 * around).alias("cost_ok"),
                    ((F.lit(best) < 0.01 * spread) & F.lit(cv.avgMetrics.index(best) == 0)).alias("cv_ok"))


def q_firewall_kmeans_check(spark, sf):
    """M9: k-means (k = 4) on categorical columns through a one-sided formula;
    every row is at its nearest centre in the encoded space."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import RFormula
    fw = fx.firewall(spark, sf)
    model = Pipeline(stages=[RFormula(formula="~ SourceIP + DestinationIP", featuresCol="features"),
                             KMeans(k=4, seed=42, featuresCol="features", predictionCol="cluster")]).fit(fw)
    km = model.stages[-1]
    centres = [list(map(float, c)) for c in km.clusterCenters()]
    pred = model.transform(fw).withColumn("v", vector_to_array("features"))
    d2 = [reduce(lambda a, b: a + b, [(F.col("v")[j] - F.lit(c[j])) ** 2 for j in range(len(c))])
          for c in centres]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("h")) for i, d in enumerate(d2)]))["h"]
    dist_own = F.element_at(F.array(*d2), F.col("cluster") + 1)
    dist_best = F.element_at(F.array(*d2), best + 1)
    return pred.agg(F.count_if(dist_own > dist_best + F.lit(1e-9)).alias("misassigned"),
                    (F.count(F.lit(1)) == F.lit(sum(km.summary.clusterSizes))).alias("sizes_ok"))


def q_logistic_check(spark, sf):
    """Logistic regression on the embeddings with a binary evaluator; the
    fitted model ranks a half-space of the vectors and probabilities are valid."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    e = fx.table(spark, sf, "embeddings")
    v = e.select(array_to_vector("embedding").alias("features"),
                 (F.col("embedding")[0] > e.agg(F.avg(F.col("embedding")[0])).scalar()).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50).fit(v)
    scored = m.transform(v)
    auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction").evaluate(scored)
    p = vector_to_array("probability")
    return scored.agg((F.max(F.abs(p[0] + p[1] - 1)) <= 1e-9).alias("probs_ok"),
                      F.lit(auc > 0.95).alias("auc_ok"))


def q_stream_batch_scores_check(spark, sf):
    """X2 (whole model through ``foreachBatch``): one file per micro-batch (more of them where
    the three arrivals have many), so hours arrive in pieces; the streamed predictions equal
    the batch predictions."""
    from hubcast.plans.roundtrips import _stream_input
    from hubcast.streaming import jobs
    models, trips = _fitted(spark, sf)
    src, schema = _stream_input(spark, sf, "parquet")
    sink, ckpt = shared_dir(spark, "stream-scores"), shared_dir(spark, "stream-ckpt")
    stream = jobs.file_stream(spark, src, schema, "parquet", max_files_per_trigger=jobs.files_per_batch(spark, src, schema))
    jobs.score_batches(stream.transform(_lower), models, sink, ckpt)
    keys = ["cluster", "pickup_year", "pickup_mon", "pickup_nday", "pickup_hour", "p_rides", "p_fpm"]
    streamed = jobs.latest_scores(spark, sink, keys)
    batch = models.predict(models.hourly(trips)).select(*keys)
    return spark.range(1).select(multiset_mismatches(streamed, batch, keys).alias("mismatches"))


def _lower(df: DataFrame) -> DataFrame:
    from hubcast.operators.clean import lower_columns
    return lower_columns(df)


RESPONSES = ("rides", "ppr", "dpr", "fpr", "tpr", "fpm", "tpm")


def q_model_summaries_check(spark, sf):
    """A1 / A4 / A6 / A8 from the fitted model: hub sizes and heat-table rides both
    add up to the clean trip count; the heat table has every observed
    weekday × hour cell; the density table has every trip, its sample respects the cap."""
    from hubcast.plans.summaries import model_summaries
    models, trips = _fitted(spark, sf, responses=())
    s = model_summaries(models, fx.raw_trips(spark, sf), density_cap=10_000)
    n_clean = _clean(spark, sf).agg(F.count(F.lit(1))).scalar()
    heat = s["s_heatmap"]
    cells = heat.agg(F.count(F.lit(1)) == F.count_distinct("pickup_wday") * F.count_distinct("pickup_hour")).scalar()
    heat_sum = heat.agg(F.sum("rides")).scalar()
    dens = s["s_blackmap"].agg(F.sum("n")).scalar()
    sampled = s["s_blackmap_sample"].agg(F.count(F.lit(1))).scalar()
    n_raw = s["s_summary"].select("n").scalar()
    return s["s_centers"].agg((F.sum("size") == n_clean).alias("centres_sum_ok"),
                              (heat_sum == n_clean).alias("heat_sum_ok"), cells.alias("heat_complete"),
                              ((dens == n_clean) & (sampled <= 10_000)).alias("density_cap_ok"),
                              (n_raw >= n_clean).alias("summary_ok"),
                              F.max(F.col("taxi_hub") == "A").alias("letters_ok"))


FACTORS, TERMS = ["cluster", "pickup_wday"], ["pickup_hour"]


def _hub_hours(spark, sf) -> DataFrame:
    """The hourly table with rates, by the fixed hubs."""
    from hubcast.ml.pipelines import rollup_transformer
    from hubcast.operators.hubs import assign_hubs
    return rollup_transformer().transform(assign_hubs(_clean(spark, sf)))


def q_grid_predictions(spark, sf):
    """The hub × weekday × hour grid scored by all seven responses (one-pass
    least squares on the hours of the fixed hubs); negative ride predictions
    clipped to 0, rates rounded."""
    hours = _hub_hours(spark, sf).persist()
    fit = fit_gram(hours, list(RESPONSES), FACTORS, TERMS)
    grid = cut_lineage(hub_week_hour_grid(hours.select("cluster")))
    hours.unpersist()
    scored = fit.predict(grid)
    return scored.select("cluster", "pickup_nday", "pickup_wday", "pickup_hour",
                         tie_round(F.greatest(F.col("p_rides"), F.lit(0.0)), 4).alias("p_rides"),
                         *[tie_round(f"p_{r}", 4).alias(f"p_{r}") for r in RESPONSES[1:]])


def q_gram_coefficients(spark, sf):
    """Coefficients and fit figures of all seven responses, solved from one Gram table
    that is merged from the tables of two parts of the hours."""
    hours = _hub_hours(spark, sf).persist()
    design = Design({"cluster": [0, 1, 2, 3, 4], "pickup_wday": ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]}, TERMS)
    early = F.col("pickup_year") < "1995"
    table = cut_lineage(merge_gram(*[gram_table(hours.where(part), design, list(RESPONSES)) for part in (early, ~early)]))
    hours.unpersist()
    fit = solve_gram(table, design, list(RESPONSES))
    figures = spark.createDataFrame([(r, s["n"], s["rmse"], s["r2"]) for r, s in fit.summary.items()], "response string, n long, rmse double, r2 double")
    return (fit.table(spark).join(figures, "response")
            .select("response", "term", "level", "n", *[tie_round(c, 6).alias(c) for c in ("coefficient", "rmse", "r2")]))


def q_gram_linreg_check(spark, sf):
    """On the hours of the fitted hubs, the one-pass solution predicts what a ``LinearRegression`` per
    response predicts; its summary figures and standard errors agree too."""
    models, trips = _fitted(spark, sf, solver="ml")
    hours = models.hourly(trips).persist()
    fit = fit_gram(hours, ["rides", "fpm"], FACTORS, TERMS)
    scored = models.predict(hours)
    again = fit.predict(scored.withColumnsRenamed({f"p_{r}": f"ml_{r}" for r in ("rides", "fpm")}))
    gap = [F.max(F.abs(F.col(f"p_{r}") - F.col(f"ml_{r}")) / (1 + F.abs(f"ml_{r}"))) for r in ("rides", "fpm")]
    worst = again.agg(F.greatest(*gap)).scalar()
    same = []
    for r in ("rides", "fpm"):
        s, m = fit.summary[r], models.regressions[r].summary
        same += [abs(s["rmse"] - m.rootMeanSquaredError) <= 1e-6 * (1 + m.rootMeanSquaredError), abs(s["r2"] - m.r2) <= 1e-6]
        ours, theirs = sorted(s["std_errors"]), sorted(m.coefficientStandardErrors)
        same.append(all(abs(a - b) <= 1e-4 * (1e-9 + abs(b)) for a, b in zip(ours, theirs, strict=True)))
    out = spark.range(1).select((worst <= 1e-6).alias("predictions_equal"), F.lit(all(same)).alias("figures_equal"))
    out = cut_lineage(out)
    hours.unpersist()
    return out


def q_kmeans_collapsed_check(spark, sf):
    """M8 on distinct points weighted by their trips: every centre is the mean of its trips (up to the last
    step's move), and the trips' squared distances are within 2 % of a fit on all trips or below."""
    trips = fx.trips(spark, sf)
    costs, drifts = [], []
    for collapse in (True, False):
        model = fit_clusters(trips, collapse=collapse)
        centres = [(float(c[1]), float(c[0])) for c in model.stages[-1].clusterCenters()]
        at = [F.element_at(F.array(*[F.lit(c[axis]) for c in centres]), F.col("cluster") + 1) for axis in (0, 1)]
        pred = model.transform(trips)
        means = pred.groupBy("cluster").agg(F.avg("start_lon").alias("x"), F.avg("start_lat").alias("y"))
        drifts.append(means.agg(F.max(F.greatest(F.abs(F.col("x") - at[0]), F.abs(F.col("y") - at[1])))).scalar())
        costs.append(pred.agg(F.sum((F.col("start_lon") - at[0]) ** 2 + (F.col("start_lat") - at[1]) ** 2)).scalar())
    return spark.range(1).select((drifts[0] <= 0.01).alias("centres_ok"), (costs[0] <= 1.02 * costs[1]).alias("cost_ok"))


def q_density_cap_check(spark, sf):
    """A8 with its cap: exactly ``min(cap, cells)`` cells, each one a cell of the
    full density table with the same count."""
    from hubcast.operators.rollup import pickup_density
    full = pickup_density(_clean(spark, sf))
    capped = sampling.sample_n(full, 10_000, seed=42)
    cells = full.agg(F.count(F.lit(1))).scalar()
    foreign = capped.join(full, ["lat_r", "lon_r", "n"], "left_anti").agg(F.count(F.lit(1))).scalar()
    return capped.agg((F.count(F.lit(1)) == F.least(cells, F.lit(10_000))).alias("size_ok"),
                      foreign.alias("foreign_cells"),
                      (F.count(F.lit(1)) == F.count_distinct("lat_r", "lon_r")).alias("distinct_cells"))


def q_grid_predictions_check(spark, sf):
    """M21 invariants: one row per observed hub × 7 weekdays × 24 hours, every
    response predicted, no negative ride prediction after clipping."""
    grid = q_grid_predictions(spark, sf)
    preds = [F.col(f"p_{r}") for r in RESPONSES]
    return grid.agg(
        (F.count(F.lit(1)) == F.count_distinct("cluster") * F.lit(7 * 24)).alias("grid_complete"),
        (F.count_if(reduce(lambda a, b: a | b, [p.isNull() for p in preds])) == 0).alias("all_predicted"),
        (F.min("p_rides") >= 0).alias("rides_clipped"))


def q_file_manifest_check(spark, sf):
    """The manifest of a CSV conversion against the files themselves, read as lines: the same names, and the bytes
    of all lines of a file (each with its line end) are the size listed; titles carry no extension and no '-'."""
    path = io.write_csv(fx.raw_trips(spark, sf), shared_dir(spark, "manifest"))
    m = io.file_manifest(spark, path, "csv", "overwrite", out_root=path + "-parquet")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    held = lines.groupBy("name").agg((F.sum(F.octet_length("value")) + F.count(F.lit(1))).alias("bytes"), F.count(F.lit(1)).alias("lines"))
    rows = fx.raw_trips(spark, sf).agg(F.count(F.lit(1))).scalar()
    j = m.join(held, m["file_name"] == held["name"], "full_outer")
    return j.agg(F.count_if(F.col("file_name").isNull() | F.col("name").isNull() | (F.col("bytes") != F.col("file_size"))).alias("different_files"),
                 (F.sum("lines") - F.count(F.lit(1)) == rows).alias("rows_complete"),
                 (F.count_if(F.col("title").contains("-") | F.col("title").endswith(".csv")) == 0).alias("titles_ok"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
