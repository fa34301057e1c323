"""Scalar column functions (F1–F16); all built-in Spark expressions."""

from hubcast.functions.calendar import (calendar_columns, month_label, shift_zone,
                                        to_day, trip_seconds)
from hubcast.functions.numeric import (clip_negative, indicator, round_half_up, tie_round,
                                       typed_null)
from hubcast.functions.text import (basename_sans_ext, dollar, format_bytes_gb, lower,
                                    number_big_mark, pad2, recode, remove_all, replace_first,
                                    split_to_columns, template)

__all__ = [
    "calendar_columns", "month_label", "shift_zone", "to_day", "trip_seconds",
    "clip_negative", "indicator", "round_half_up", "tie_round", "typed_null",
    "basename_sans_ext", "dollar", "format_bytes_gb", "lower", "number_big_mark", "pad2",
    "recode", "remove_all", "replace_first", "split_to_columns", "template",
]
