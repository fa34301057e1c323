"""Hub operators: nearest-centre assignment (J6), centres and profiles (A4, A5,
A25, J2), letters, colours and shares by size (W1, W2, W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Five hub centres (lon, lat) used when no fitted model is given.
FIXED_HUBS = [(-74.00, 40.65), (-73.98, 40.75), (-73.87, 40.77), (-73.95, 40.84), (-73.80, 40.64)]

# The 9-colour "Pastel1" qualitative palette, in order.
PASTEL1 = ["#FBB4AE", "#B3CDE3", "#CCEBC5", "#DECBE4", "#FED9A6",
           "#FFFFCC", "#E5D8BD", "#FDDAEC", "#F2F2F2"]


def nearest_hub(lon: str, lat: str, centres=FIXED_HUBS) -> Column:
    """Id of the nearest centre by squared Euclidean distance, ties to the lower id.

    A pure column expression (``array_min`` over ``(distance, id)`` structs): no
    join, no shuffle, stays inside whole-stage codegen.
    """
    x, y = F.col(lon), F.col(lat)
    cand = []
    for i, (cx, cy) in enumerate(centres):
        dx, dy = x - F.lit(float(cx)), y - F.lit(float(cy))
        cand.append(F.struct((dx * dx + dy * dy).alias("d"), F.lit(i).alias("h")))
    return F.array_min(F.array(*cand))["h"]


def assign_hubs(df: DataFrame, centres=FIXED_HUBS, lon: str = "start_lon",
                lat: str = "start_lat", out: str = "cluster") -> DataFrame:
    return df.withColumn(out, nearest_hub(lon, lat, centres))


def hub_centres(df: DataFrame, cluster: str = "cluster", lon: str = "start_lon",
                lat: str = "start_lat", extra_means=()) -> DataFrame:
    """A4 + W1 + W2 + W4: centre, size, letter (largest = A), colour and share per hub.

    The group-by has partial (map-side) aggregation, so a hub holding a third
    of all rows costs no more than any other.  Rank, letter and share are
    windows over the k-row aggregate (k = number of hubs), so the
    single-partition window step handles k rows, never the trips.
    ``extra_means`` adds attribute means to the same single aggregation pass.
    """
    agg = df.groupBy(cluster).agg(F.avg(lon).alias("center_lon"), F.avg(lat).alias("center_lat"),
                                  F.count(F.lit(1)).alias("size"),
                                  *[F.avg(c).alias(c) for c in extra_means])
    return decorate_centres(agg, cluster, extra_means)


def decorate_centres(agg: DataFrame, cluster: str = "cluster", extra_means=()) -> DataFrame:
    """W1 + W2 + W4 on a k-row table of (cluster, center_lon, center_lat, size)."""
    total = F.sum("size").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("size"), F.col(cluster)))
    palette = F.array(*[F.lit(c) for c in PASTEL1])
    return (agg.withColumn("_rank", rank)
            .select(cluster, "center_lon", "center_lat", "size",
                    hub_letters("_rank").alias("taxi_hub"),
                    F.element_at(palette, ((F.col("_rank") - 1) % len(PASTEL1) + 1).cast("int")).alias("hub_color"),
                    (F.col("size") / total).alias("hub_pct"), *list(extra_means)))


def hub_letters(rank: str) -> Column:
    """W1 for any rank: A..Z, then AA, AB, ... (three letters cover 18,278 hubs).  Colours repeat after nine."""
    def letter(n):
        return F.char(F.lit(65) + n % 26)
    last = F.col(rank) - 1
    middle = F.floor(last / 26) - 1
    first = F.floor(middle / 26) - 1
    return (F.when(last < 26, letter(last)).when(middle < 26, F.concat(letter(middle), letter(last)))
            .otherwise(F.concat(letter(first), letter(middle), letter(last))))


def hub_means(df: DataFrame, cluster: str = "cluster",
              columns=("passenger_count", "trip_distance", "fare_amt", "tip_amt")) -> DataFrame:
    """A5: mean of each attribute per hub."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


HUB_ATTRIBUTES = ("passenger_count", "trip_distance", "fare_amt", "tip_amt")


def hub_profile(df: DataFrame, cluster: str = "cluster", join: bool = False) -> DataFrame:
    """Hub centres with hub attribute means.

    Default: one aggregation pass computes both (one scan, one shuffle).
    ``join=True`` builds the two k-row tables separately and left-joins them,
    as the original did — two scans of the input.
    """
    if join:
        return hub_centres(df, cluster).join(hub_means(df, cluster), on=cluster, how="left")
    return hub_centres(df, cluster, extra_means=HUB_ATTRIBUTES)


def map_centre(centres: DataFrame) -> DataFrame:
    """Mean of the hub centres."""
    return centres.agg(F.avg("center_lon").alias("center_lon"),
                       F.avg("center_lat").alias("center_lat"))
