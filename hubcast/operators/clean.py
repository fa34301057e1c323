"""Projections and filters: P1–P13."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubcast.functions.calendar import trip_seconds


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


@dataclass(frozen=True)
class TripBounds:
    """Open (strict) bounds of the plausibility filter.

    Fixed values: the default box and ranges of the original clean stage.
    """
    lon_min: float = -74.05
    lon_max: float = -73.75
    lat_min: float = 40.58
    lat_max: float = 40.90
    passengers_min: float = 0.0
    passengers_max: float = 7.0
    distance_min: float = 0.0
    distance_max: float = 100.0
    total_min: float = 0.0


DEFAULT_BOUNDS = TripBounds()


def plausibility_condition(b: TripBounds = DEFAULT_BOUNDS, require_pickup: bool = True) -> Column:
    """P2 predicate over lower-case trip columns.  All bounds are strict.

    ``total_amt > 0`` has no upper bound, so NaN passes it (NaN > 0 is true in
    Spark); this is kept as originally specified.
    """
    c = F.col
    cond = ((c("start_lon") > b.lon_min) & (c("start_lon") < b.lon_max)
            & (c("start_lat") > b.lat_min) & (c("start_lat") < b.lat_max)
            & (c("end_lon") > b.lon_min) & (c("end_lon") < b.lon_max)
            & (c("end_lat") > b.lat_min) & (c("end_lat") < b.lat_max)
            & (c("passenger_count") > b.passengers_min) & (c("passenger_count") < b.passengers_max)
            & (c("trip_distance") > b.distance_min) & (c("trip_distance") < b.distance_max)
            & (c("total_amt") > b.total_min))
    if require_pickup:
        cond = cond & c("trip_pickup_datetime").isNotNull()
    return cond


def plausible_trips(df: DataFrame, bounds: TripBounds = DEFAULT_BOUNDS,
                    require_pickup: bool = True) -> DataFrame:
    """Keep trips inside the box and ranges (pushed down to the Parquet scan)."""
    return df.where(plausibility_condition(bounds, require_pickup))


def prepared_trips(df: DataFrame, bounds: TripBounds = DEFAULT_BOUNDS) -> DataFrame:
    """P1 + P2 + F1 + F7: lower-cased names, plausible rows, lower-case payment type
    and trip duration in seconds."""
    t = plausible_trips(lower_columns(df), bounds)
    return t.withColumns({
        "payment_type": F.lower("payment_type"),
        "trip_time": trip_seconds("trip_pickup_datetime", "trip_dropoff_datetime"),
    })


def where_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter."""
    return df.where(F.col(column) == F.lit(value))


def where_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """P5: regular-expression filter."""
    return df.where(F.col(column).rlike(pattern))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in table order."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1] if i <= j else cols[j:i + 1]


def select_columns(df: DataFrame, *items, exclude: list[str] | None = None,
                   rename: dict[str, str] | None = None) -> DataFrame:
    """Select by name or ``(first, last)`` range, drop ``exclude``, rename."""
    names: list[str] = []
    for it in items or df.columns:
        names.extend(column_range(df, *it) if isinstance(it, tuple) else [it])
    names = [n for n in names if n not in set(exclude or [])]
    rename = rename or {}
    return df.select(*[F.col(n).alias(rename.get(n, n)) for n in names])


def last_column(df: DataFrame) -> str:
    return df.columns[-1]


def transmute(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Keep only the new columns."""
    return df.select(*[col.alias(name) for name, col in columns.items()])


def case_when(pairs: list[tuple[Column, object]], otherwise=None) -> Column:
    """P10: first matching condition wins."""
    expr = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if otherwise is not None:
        expr = expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return expr


# Weekday labels Monday first, the order of the published heat table.
WEEKDAYS_MON_FIRST = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def level_rank(col, levels: list[str]) -> Column:
    """Position of a value in an ordered list of levels (1-based, 0 = absent)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(v) for v in levels]), c).cast("int")


def first_appearance_rank(df: DataFrame, value: str, order_key: str) -> DataFrame:
    """P12 (``fct_inorder``): rank of each distinct value by its first appearance
    (ties broken by the value itself).

    One row per distinct value; the ranking is a distributed row number
    (bucketed running counts), so no single task holds all levels.
    """
    from hubcast.operators.ranking import distributed_row_number
    levels = df.groupBy(value).agg(F.min(order_key).alias("_first"))
    ranked = distributed_row_number(levels, "_first", tiebreak=(value,), out=f"{value}_rank")
    return ranked.select(value, f"{value}_rank")
