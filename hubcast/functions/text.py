"""String functions: F1–F6, F12 formatting, F16 recode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    return F.lower(_c(col))


def pad2(col, width: int = 2, pad: str = "0") -> Column:
    """Left pad (e.g. hour 7 -> '07')."""
    return F.lpad(_c(col).cast("string"), width, pad)


def template(fmt: str, *cols) -> Column:
    """``format_string`` template, e.g. ``template('%s-%s', 'year', 'mon')``."""
    return F.format_string(fmt, *[_c(c) for c in cols])


def replace_first(col, pattern: str, replacement: str) -> Column:
    """Replace the first match only (``str_replace``)."""
    return F.regexp_replace(_c(col), f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def remove_all(col, pattern: str) -> Column:
    """Remove every match (``str_remove_all``)."""
    return F.regexp_replace(_c(col), pattern, "")


def split_to_columns(col, sep: str, names: list[str]) -> list[Column]:
    """Split one string into named columns (``separate``)."""
    parts = F.split(_c(col), sep, len(names))
    return [parts.getItem(i).alias(n) for i, n in enumerate(names)]


def basename_sans_ext(col) -> Column:
    """File name without folders and without the last extension."""
    return F.regexp_extract(_c(col), r"([^/]+?)(\.[^./]*)?$", 1)


def number_big_mark(col, digits: int = 0) -> Column:
    """Thousands separators, e.g. 1234567 -> '1,234,567'."""
    return F.format_number(_c(col), digits)


def dollar(col, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(col), digits))


def format_bytes_gb(col, digits: int = 2) -> Column:
    """Bytes as gigabytes (base 1024), rounded."""
    return F.round(_c(col) / F.lit(1024.0 ** 3), digits)


def recode(col, mapping: dict, default=None) -> Column:
    """Map values through a literal lookup; unmatched values keep ``default``
    (or themselves when no default is given)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, _c(col))
    return F.coalesce(looked, _c(col) if default is None else F.lit(default))
