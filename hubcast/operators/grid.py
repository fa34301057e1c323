"""Row generation: densify (J5), prediction grids (J4), URL manifest (S7),
weekday lookup (J1).  No cross joins: grids are generated per row with
``sequence`` + ``explode`` or from ``spark.range``; level lists are scalar
subqueries, never larger than the grid they make.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def observed_levels(df: DataFrame, col: str) -> Column:
    """Sorted distinct values of ``col`` as an array (one scalar subquery); NULL, if it occurs, is a level and comes last.

    The grid built from it has the product of all level counts as rows, so the
    array is never larger than the result.
    """
    seen = F.array_sort(F.collect_list(col))
    with_null = F.when(F.count_if(F.col(col).isNull()) > 0, F.array_append(seen, F.lit(None))).otherwise(seen)
    return df.select(col).distinct().agg(with_null.alias("levels")).scalar()


def densify(df: DataFrame, keys: list[str], fill: dict | None = None, cache: bool = True) -> DataFrame:
    """J5 (``complete``): every combination of *observed* key values is present;
    ``fill`` gives values for the measure columns of added rows.  NULL keys are
    levels like any other: their rows are kept and combined.

    The input is normally an aggregate (one row per observed key combination).
    It is read three times (distinct first key, level arrays, join back), so it
    is cached once (``cache=True``) instead of being recomputed from the source
    by each branch; the cache holds only that aggregate and can be released
    with ``spark.catalog.clearCache()`` once the result is written.  The first key's distinct values stay distributed; the
    other keys' levels are arrays exploded per row.
    """
    fill = dict(fill or {})
    unknown = [c for c in fill if c not in df.columns]
    if unknown:
        raise ValueError(f"densify: fill names unknown columns {unknown}")
    if cache:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    grid = df.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.withColumn(k, F.explode(observed_levels(df, k)))
    sought = grid.select(*[F.col(k).alias(f"_sought_{k}") for k in keys])
    same = [F.col(f"_sought_{k}").eqNullSafe(F.col(k)) for k in keys]
    out = sought.join(df, on=same, how="left").select(*[F.col(f"_sought_{k}").alias(k) for k in keys], *[c for c in df.columns if c not in keys])
    return out.fillna(fill) if fill else out


def expand_ids(df: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Add a column holding ``start..stop`` for every row (one row per value)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(stop))))


def hub_week_hour_grid(hubs: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Observed hub ids × weekday 1..7 × hour 0..23 (Sunday = 1)."""
    grid = hubs.select(F.col(cluster).cast("int").alias(cluster)).distinct()
    grid = expand_ids(expand_ids(grid, "pickup_nday", 1, 7), "pickup_hour", 0, 23)
    return grid.withColumn("pickup_wday", weekday_name("pickup_nday"))


# Weekday names for dayofweek numbers 1..7 (Sunday = 1).
WEEKDAYS_SUN_FIRST = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def weekday_name(nday) -> Column:
    c = F.col(nday) if isinstance(nday, str) else nday
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS_SUN_FIRST]), c.cast("int"))


def weekday_lookup(spark: SparkSession) -> DataFrame:
    """The 7-row weekday dimension (pickup_nday, pickup_wday)."""
    return spark.range(1, 8, numPartitions=1).select(
        F.col("id").cast("int").alias("pickup_nday"), weekday_name(F.col("id")).alias("pickup_wday"))


def with_weekday(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Left join to the weekday dimension.  The dimension is exactly 7 rows, so
    broadcasting it is size-safe at any scale."""
    spark = spark or df.sparkSession
    return df.join(F.broadcast(weekday_lookup(spark)), on="pickup_nday", how="left")


def linspace_grid(df: DataFrame, x: str, y: str, n: int = 200) -> DataFrame:
    """``n × n`` evenly spaced points spanning the observed range of two columns.

    The bounds are scalar subqueries; points are generated by ``spark.range``
    (distributed row generation, no join).
    """
    spark = df.sparkSession
    b = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"),
                        F.min(y).alias("y0"), F.max(y).alias("y1")).alias("b")).scalar()
    x0, x1, y0, y1 = b["x0"], b["x1"], b["y0"], b["y1"]
    ids = spark.range(n * n)
    i = (F.col("id") / n).cast("long")
    j = F.col("id") % n
    step_x = (x1 - x0) / F.lit(n - 1)
    step_y = (y1 - y0) / F.lit(n - 1)
    return ids.select((x0 + i * step_x).alias(x), (y0 + j * step_y).alias(y))


# Public location of the monthly yellow-taxi files and name pattern.
TRIP_FILE_URL = "https://s3.amazonaws.com/nyc-tlc/trip+data/yellow_tripdata"


def url_manifest(df: DataFrame, ts: str = "trip_pickup_datetime", base_url: str = TRIP_FILE_URL) -> DataFrame:
    """File name and URL for every year-month present in the data."""
    months = df.select(F.date_format(ts, "yyyy").alias("year"),
                       F.date_format(ts, "MM").alias("month")).where(F.col("year").isNotNull()).distinct()
    fname = F.concat_ws("-", "year", F.concat(F.col("month"), F.lit(".csv")))
    return months.select("year", "month", fname.alias("filename"),
                         F.concat_ws("_", F.lit(base_url), fname).alias("url"))


def url_calendar(df: DataFrame, ts: str = "trip_pickup_datetime", base_url: str = TRIP_FILE_URL,
                 first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """File name and URL of every month from ``first_year`` to ``last_year``
    (those of the data where not given), so files not yet loaded can be named;
    ``seen`` tells whether the data hold the month.  One row per year is exploded."""
    year = F.year(ts)
    span = df.agg(F.coalesce(F.lit(first_year), F.min(year)).alias("a"), F.coalesce(F.lit(last_year), F.max(year)).alias("b"))
    months = (span.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("y"))
              .select(F.col("y").cast("string").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
              .select("year", F.lpad(F.col("m").cast("string"), 2, "0").alias("month")))
    fname = F.concat_ws("-", "year", F.concat(F.col("month"), F.lit(".csv")))
    seen = url_manifest(df, ts, base_url).select("year", "month", F.lit(True).alias("seen"))
    return (months.select("year", "month", fname.alias("filename"), F.concat_ws("_", F.lit(base_url), fname).alias("url"))
            .join(seen, ["year", "month"], "left").withColumn("seen", F.coalesce("seen", F.lit(False))))
