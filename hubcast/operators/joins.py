"""Joins: N-way reduce join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def reduce_left_join(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left-join a list of tables on the same keys, in order.

    Each join is planned by Catalyst; AQE turns a join into a broadcast only when
    the measured side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    When the inputs are aggregates of one table, computing all measures in a
    single ``agg`` avoids the joins altogether.
    """
    return reduce(lambda a, b: a.join(b, on=keys, how="left"), frames)
