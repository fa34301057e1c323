"""Time functions: trip duration (F7), zone shift (F8), calendar parts (F9), dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trip_seconds(pickup, dropoff) -> Column:
    """Duration in whole seconds: ``unix_timestamp(dropoff) - unix_timestamp(pickup)``."""
    return F.unix_timestamp(_c(dropoff)) - F.unix_timestamp(_c(pickup))


def shift_zone(ts, zone: str | None) -> Column:
    """``to_utc_timestamp(ts, zone)``; ``None`` or ``'UTC'`` is the identity.

    A fixed zone id such as ``'EST'`` shifts every value by the same offset
    (+5 h), all year.
    """
    if zone is None or zone.upper() == "UTC":
        return _c(ts)
    return F.to_utc_timestamp(_c(ts), zone)


def calendar_columns(ts, zone: str | None = None, prefix: str = "pickup_") -> dict[str, Column]:
    """Calendar parts of one (optionally zone-shifted) timestamp.

    Uses calendar-year patterns (``yyyy``, ``dd``): the week-year / day-of-year
    patterns of the original stage are wrong near New Year.  Hour and weekday
    come from the same shifted value.  Weekday number: Sunday = 1.
    """
    t = shift_zone(ts, zone)
    return {
        f"{prefix}date": F.date_format(t, "yyyy-MM-dd"),
        f"{prefix}year": F.date_format(t, "yyyy"),
        f"{prefix}mon": F.date_format(t, "MM"),
        f"{prefix}day": F.date_format(t, "dd"),
        f"{prefix}hour": F.hour(t).cast("int"),
        f"{prefix}wday": F.date_format(t, "E"),
        f"{prefix}nday": F.dayofweek(t).cast("int"),
    }


def to_day(ts) -> Column:
    """Timestamp to calendar date."""
    return F.to_date(_c(ts))


def month_label(ts, pattern: str = "MMM yyyy") -> Column:
    """Month-year label such as ``Jan 2009`` (or ``dd MMM yyyy``)."""
    return F.date_format(_c(ts), pattern)
