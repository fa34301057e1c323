"""Flagship: hourly hub rollup with unit rates.

Physical plan: one Parquet scan with the plausibility predicates pushed down
and only the 11 used columns read → a single whole-stage-codegen span
(filter, hub expression, calendar parts, partial hash aggregate) → one shuffle
of partial aggregates keyed by the six group keys → final aggregate and rates.
A hub holding a third of all trips is pre-combined in every task before the
shuffle, so the exchange carries at most (tasks × groups) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from hubcast.operators.clean import DEFAULT_BOUNDS, TripBounds, lower_columns, plausible_trips
from hubcast.operators.hubs import FIXED_HUBS, assign_hubs
from hubcast.operators.rollup import hourly_rollup, unit_rates, with_calendar


def clean_hub_trips(raw_trips: DataFrame, centres=FIXED_HUBS, bounds: TripBounds = DEFAULT_BOUNDS,
                    zone: str | None = None) -> DataFrame:
    """Lower-case names, plausible rows, hub id and calendar parts."""
    t = plausible_trips(lower_columns(raw_trips), bounds)
    return with_calendar(assign_hubs(t, centres), "trip_pickup_datetime", zone)


def hourly_hub_rates(raw_trips: DataFrame, centres=FIXED_HUBS, bounds: TripBounds = DEFAULT_BOUNDS,
                     zone: str | None = None) -> DataFrame:
    return unit_rates(hourly_rollup(clean_hub_trips(raw_trips, centres, bounds, zone)))
