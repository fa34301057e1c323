"""Distributed running totals over a global value order.

A global order normally forces a single-partition window.  Here values are
first pre-aggregated (``value → count``, partial aggregation absorbs hot
values), then split into ``buckets`` value ranges whose boundaries come from a
bounded ``percentile_approx`` sketch.  Running totals are computed per bucket
(window partitioned by bucket) plus a bucket offset taken from a window over
the ``buckets``-row table of bucket totals, broadcast back (its size is the
bucket count, a parameter).  No step holds more than one bucket of distinct
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket_of(v: Column, bounds: Column) -> Column:
    """Index of the value range containing ``v``: number of boundaries below it.
    ``bounds`` must be a column (subqueries are not allowed inside lambdas)."""
    return F.size(F.filter(bounds, lambda b: b < v))


def running_count(values: DataFrame, v: str, c: str, buckets: int = 512,
                  accuracy: int = 100_000, tiebreak: tuple = ()) -> DataFrame:
    """For a table of values ``v`` (numeric) with counts ``c``, add ``cum`` (rows up
    to and including this one) and ``cum_before``, in global order of ``v`` then
    ``tiebreak``.  With distinct ``v`` this is "rows with value ≤ v"; equal
    ``v`` always share a bucket, so ``tiebreak`` columns order them exactly."""
    bounds = values.agg(F.array_distinct(F.percentile_approx(
        v, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), accuracy)).alias("b")).scalar()
    tagged = values.withColumn("_bounds", bounds).withColumn("_b", _bucket_of(F.col(v), F.col("_bounds"))) \
        .drop("_bounds")
    within = Window.partitionBy("_b").orderBy(v, *tiebreak).rowsBetween(Window.unboundedPreceding,
                                                                         Window.currentRow)
    tagged = tagged.withColumn("_local", F.sum(c).over(within))
    totals = tagged.groupBy("_b").agg(F.sum(c).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_b")
    return (out.withColumn("cum", F.col("_off") + F.col("_local"))
            .withColumn("cum_before", F.col("cum") - F.col(c))
            .drop("_b", "_local", "_off"))


def distributed_row_number(df: DataFrame, order: str, tiebreak: tuple = (), out: str = "rank",
                           buckets: int = 512) -> DataFrame:
    """1-based row number in global order of ``order`` (numeric, date or
    timestamp) then ``tiebreak`` — without a single-partition window."""
    key = F.col(order)
    dtype = dict(df.dtypes)[order]
    if dtype.startswith("timestamp"):
        key = F.unix_micros(key.cast("timestamp"))
    elif dtype == "date":
        key = F.unix_date(key)
    tagged = df.withColumn("_ord", key).withColumn("_one", F.lit(1))
    ranked = running_count(tagged, "_ord", "_one", buckets, tiebreak=tuple(tiebreak))
    return ranked.withColumn(out, F.col("cum").cast("long")).drop("_ord", "_one", "cum", "cum_before")
