"""Aggregations: A1–A14, A20, A21, A23, A24, A27.

All group-bys are hash aggregates with partial (map-side) aggregation, so a
hot key is pre-combined in every task before the shuffle; shuffled bytes grow
with the number of groups, not with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubcast.functions.calendar import calendar_columns
from hubcast.functions.text import pad2
from hubcast.operators.clean import WEEKDAYS_MON_FIRST, level_rank
from hubcast.operators.grid import densify

HOURLY_KEYS = ["cluster", "pickup_year", "pickup_mon", "pickup_wday", "pickup_nday", "pickup_hour"]
HOURLY_SUMS = {"passengers": "passenger_count", "distance": "trip_distance",
               "fare": "fare_amt", "tip": "tip_amt"}


def dataset_summary(df: DataFrame, ts: str = "trip_pickup_datetime") -> DataFrame:
    """A1: row count and first / last day."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min(ts)).alias("date_min"),
                  F.to_date(F.max(ts)).alias("date_max"))


def with_calendar(df: DataFrame, ts: str = "trip_pickup_datetime", zone: str | None = None) -> DataFrame:
    """F9 columns for the hourly keys."""
    return df.withColumns(calendar_columns(ts, zone))


def hourly_rollup(df: DataFrame, keys=HOURLY_KEYS, sums=HOURLY_SUMS) -> DataFrame:
    """A2: rides and summed measures per hub × year × month × weekday × hour."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rides"),
                                 *[F.sum(src).alias(out) for out, src in sums.items()])


def unit_rates(df: DataFrame) -> DataFrame:
    """A3: per-ride and per-mile rates; an empty denominator gives NULL, not an error."""
    return df.withColumns({
        "ppr": F.try_divide("passengers", "rides"),
        "dpr": F.try_divide("distance", "rides"),
        "fpr": F.try_divide("fare", "rides"),
        "tpr": F.try_divide("tip", "rides"),
        "fpm": F.try_divide("fare", "distance"),
        "tpm": F.try_divide("tip", "distance"),
    })


def week_hour_heat(df: DataFrame, rides: str | None = "rides", fare: str = "fare",
                   distance: str = "distance") -> DataFrame:
    """Weekday × hour table of rides and fare per mile (ratio of sums).

    ``rides=None`` counts rows (trips input, A7); otherwise sums the rides column
    of an hourly rollup (A6).  Every observed weekday × observed hour cell is
    present (``complete``), missing cells filled with 0; weekdays ranked
    Mon..Sun (P12); hour padded to two characters.

    Plan: one scalable aggregation (partial + final) down to at most 7 × 24 = 168
    rows; everything after it works on that bounded table in one pass — the
    observed hour levels come from a window over the ≤ 168 rows, each weekday's
    observed cells are looked up in a per-weekday map while the hour levels
    are exploded, so no join, cache or extra scan is needed, and the final
    sort runs on one partition of ≤ 168 rows.
    """
    n = F.count(F.lit(1)) if rides is None else F.sum(rides)
    agg = df.groupBy("pickup_wday", "pickup_hour").agg(
        n.cast("long").alias("rides"), F.try_divide(F.sum(fare), F.sum(distance)).alias("fpm"))
    return complete_heat(agg)


def complete_heat(agg: DataFrame) -> DataFrame:
    """Complete, rank and pad a (pickup_wday, pickup_hour, rides, fpm) table of at
    most 7 × 24 rows (see :func:`week_hour_heat`)."""
    hours = F.array_sort(F.collect_set("pickup_hour").over(Window.partitionBy()))
    per_day = (agg.withColumn("_hours", hours)
               .groupBy("pickup_wday")
               .agg(F.map_from_entries(F.collect_list(F.struct("pickup_hour", F.struct("rides", "fpm"))))
                    .alias("_cells"), F.first("_hours").alias("_hours")))
    full = per_day.select("pickup_wday", F.explode("_hours").alias("pickup_hour"), "_cells").select(
        "pickup_wday", "pickup_hour",
        F.coalesce(F.element_at("_cells", F.col("pickup_hour"))["rides"], F.lit(0).cast("long")).alias("rides"),
        F.coalesce(F.element_at("_cells", F.col("pickup_hour"))["fpm"], F.lit(0.0)).alias("fpm"))
    return (full.withColumn("wday_rank", level_rank("pickup_wday", WEEKDAYS_MON_FIRST))
            .withColumn("pickup_hour", pad2("pickup_hour"))
            .coalesce(1).sortWithinPartitions("wday_rank", "pickup_hour"))


def hub_hour_complete(df: DataFrame) -> DataFrame:
    """J5 on a hub × hour count: every observed hub × every observed hour, 0 where
    no trip was seen (generic ``densify`` with bounded level arrays)."""
    counts = df.groupBy("cluster", "pickup_hour").agg(F.count(F.lit(1)).alias("rides"))
    return densify(counts, ["cluster", "pickup_hour"], fill={"rides": 0})


def pickup_density(df: DataFrame, lon: str = "start_lon", lat: str = "start_lat",
                   digits: int = 3) -> DataFrame:
    """Trips per rounded location cell."""
    return df.groupBy(F.round(lat, digits).alias("lat_r"), F.round(lon, digits).alias("lon_r")) \
        .agg(F.count(F.lit(1)).alias("n"))


def location_cells(df: DataFrame, lon: str = "start_lon", lat: str = "start_lat",
                   value: str = "fare_amt", digits: int = 4) -> DataFrame:
    """Mean value and trip count per rounded cell, busiest first."""
    return (df.groupBy(F.round(lon, digits).alias("lon_r"), F.round(lat, digits).alias("lat_r"))
            .agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "lon_r", "lat_r"))


def frequency(df: DataFrame, *keys, sort: bool = True, name: str = "n") -> DataFrame:
    """Row count per key combination, optionally largest first."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.desc(name), *keys) if sort else out


def rides_by_passengers(df: DataFrame, col: str = "passenger_count") -> DataFrame:
    """Rides by passenger count, label padded to two characters."""
    return (df.groupBy(pad2(F.col(col).cast("int")).alias("passengers"))
            .agg(F.count(F.lit(1)).alias("n")))


def binned_counts(df: DataFrame, col: str, how: str = "round", digits: int = 1,
                  name: str = "bin") -> DataFrame:
    """Counts of ``round(x, digits)`` or ``floor(x)``."""
    key = F.round(col, digits) if how == "round" else F.floor(col).cast("long")
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean of columns by group."""
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def share_table(df: DataFrame, key: str) -> DataFrame:
    """One-way table with share of total.

    The total is a scalar subquery over the grouped counts themselves; Spark
    reuses the counts' shuffle for it (``ReusedExchange``), so the input is
    scanned once and no window puts all keys into one partition.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") / total)


def contingency(df: DataFrame, row: str, col: str, values: list[str] | None = None, other: str = "other") -> DataFrame:
    """Two-way table of counts, absent cells 0.

    Pass ``values`` to fix the columns and avoid the extra distinct-values job;
    rows with any other value (or none) are counted in the column ``other``, so
    every row of ``df`` is in the table.  Without ``values`` Spark discovers them,
    bounded by ``spark.sql.pivotMaxValues``.
    """
    if values is not None:
        df = df.withColumn(col, F.when(F.col(col).isin(values), F.col(col)).otherwise(F.lit(other)))
        values = [*values, other]
    pivoted = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    fill_cols = [c for c in pivoted.columns if c != row]
    return pivoted.fillna(0, subset=fill_cols)


def row_count(df: DataFrame) -> DataFrame:
    """Count as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def distinct_rows(df: DataFrame, *cols) -> DataFrame:
    """Distinct rows (or distinct combinations of ``cols``)."""
    return (df.select(*cols) if cols else df).distinct()


def first_per_key(df: DataFrame, key: str, order) -> DataFrame:
    """A24 variant: one row per key, the row with the smallest ``order`` (a column
    or a list of columns compared left to right; include a unique column to
    break ties).  ``min_by`` is a partial aggregate: one candidate row per key
    and task crosses the shuffle, however large the group."""
    others = [c for c in df.columns if c != key]
    order_col = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order)
    picked = F.min_by(F.struct(*others), order_col)
    return df.groupBy(key).agg(picked.alias("_r")).select(key, "_r.*")


def long_to_wide(df: DataFrame, key: str, names_from: str, values_from: str,
                 names: list[str] | None = None) -> DataFrame:
    """``pivot_wider``; first value per cell."""
    return df.groupBy(key).pivot(names_from, names).agg(F.first(values_from, ignorenulls=True))


def apply_to(columns: list[str], fn) -> dict[str, Column]:
    """The same function over several columns (``mutate_at``)."""
    return {c: fn(F.col(c)) for c in columns}
