"""The four published summaries and their dated bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hubcast.operators.hubs import hub_centres
from hubcast.operators.rollup import dataset_summary, pickup_density, week_hour_heat
from hubcast.operators.sampling import sample_n


def summaries(raw_trips: DataFrame, clustered: DataFrame, hourly: DataFrame,
              density_cap: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """``s_summary`` (raw rows), ``s_centers``, ``s_heatmap``, ``s_blackmap`` (every cell).

    With ``density_cap`` there is also ``s_blackmap_sample``, at most that many
    random cells for a map (top-k in Spark, never more rows than exist).
    """
    density = pickup_density(clustered)
    return _with_sample({
        "s_summary": dataset_summary(raw_trips, "trip_pickup_datetime"),
        "s_centers": hub_centres(clustered),
        "s_heatmap": week_hour_heat(hourly),
        "s_blackmap": density,
    }, density_cap, seed)


def _with_sample(tables: dict[str, DataFrame], density_cap: int | None, seed: int) -> dict[str, DataFrame]:
    return tables if density_cap is None else {**tables, "s_blackmap_sample": sample_n(tables["s_blackmap"], density_cap, seed)}


def summaries_one_pass(raw_trips: DataFrame, clustered: DataFrame, density_cap: int | None = None,
                       seed: int = 42) -> dict[str, DataFrame]:
    """The same four summaries, with centres, heat table and density computed by
    ONE grouping-sets aggregation over the clustered trips: one scan, one
    ``Expand`` (three groupings per row), partial aggregation, one shuffle.
    The small result (k + ≤ 168 + cells rows) is cached and split by grouping.
    The heat table sums trips per weekday × hour directly, which equals summing
    the hourly rollup."""
    from pyspark import StorageLevel
    from pyspark.sql import functions as F

    from hubcast.functions.calendar import calendar_columns
    from hubcast.operators.hubs import decorate_centres
    from hubcast.operators.rollup import complete_heat

    cal = calendar_columns("trip_pickup_datetime")
    base = clustered.select("cluster", "start_lon", "start_lat", "fare_amt", "trip_distance",
                            cal["pickup_wday"].alias("pickup_wday"), cal["pickup_hour"].alias("pickup_hour"),
                            F.round("start_lat", 3).alias("lat_r"), F.round("start_lon", 3).alias("lon_r"))
    keys = ["cluster", "pickup_wday", "pickup_hour", "lat_r", "lon_r"]
    g = (base.groupingSets([["cluster"], ["pickup_wday", "pickup_hour"], ["lat_r", "lon_r"]], *keys)
         .agg(*[F.grouping(k).alias(f"_g_{k}") for k in ("cluster", "pickup_wday", "lat_r")],
              F.count(F.lit(1)).alias("n"), F.avg("start_lon").alias("center_lon"),
              F.avg("start_lat").alias("center_lat"), F.sum("fare_amt").alias("fare"),
              F.sum("trip_distance").alias("distance"))
         .persist(StorageLevel.MEMORY_AND_DISK))
    centres = g.where(F.col("_g_cluster") == 0).select(
        "cluster", "center_lon", "center_lat", F.col("n").alias("size"))
    heat = g.where(F.col("_g_pickup_wday") == 0).select(
        "pickup_wday", "pickup_hour", F.col("n").alias("rides"),
        F.try_divide(F.col("fare"), F.col("distance")).alias("fpm"))
    density = g.where(F.col("_g_lat_r") == 0).select("lat_r", "lon_r", "n")
    return _with_sample({
        "s_summary": dataset_summary(raw_trips, "trip_pickup_datetime"),
        "s_centers": decorate_centres(centres),
        "s_heatmap": complete_heat(heat),
        "s_blackmap": density,
    }, density_cap, seed)


def model_summaries(models, raw_trips: DataFrame, density_cap: int | None = None,
                    seed: int = 42) -> dict[str, DataFrame]:
    """The four summaries from a fitted model: hubs are the fitted k-means
    clusters (training assignments recomputed by ``transform``); centres, heat
    table and density come from one grouping-sets pass."""
    from hubcast.operators.clean import lower_columns
    trips = lower_columns(raw_trips)
    return summaries_one_pass(raw_trips, models.assign(trips), density_cap, seed)


def write_bundle(tables: dict[str, DataFrame], out_dir: str, run_date: str) -> dict[str, str]:
    """K8: one Parquet directory per summary under ``<out>/<run_date>/``."""
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{run_date}/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths
