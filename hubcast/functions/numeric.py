"""Numeric helpers: rounding (F11), nulls (F13), indicators (F14), clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col, digits: int = 0) -> Column:
    return F.round(_c(col), digits)


def tie_round(col, digits: int = 6) -> Column:
    """Engine-independent rounding of a double: ``round(x * (1 + 1e-12), digits)``.

    Sums of doubles differ in the last bits between engines; nudging by one
    part in 10^12 before rounding makes decimal ties fall the same way.
    """
    return F.round(_c(col) * F.lit(1.0 + 1e-12), digits)


def typed_null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def indicator(cond: Column) -> Column:
    """1 when the condition holds, else 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def clip_negative(col) -> Column:
    """Negative values become 0 (nulls stay null)."""
    c = _c(col)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)
