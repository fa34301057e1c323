"""Run logs: schema-drift union (U1), stacking (U2), latest entry (O3),
totals by environment and stage (A26), timed steps (K9)."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.operators.clean import where_matches
from hubcast.sources.schemas import RUNLOG_SCHEMA

# Older header names and the canonical name they map to.
RUNLOG_RENAMES = {"time": "runtime", "n_rows": "n_row"}
RUNLOG_COLUMNS = ["action", "runtime", "timestamp", "run_env", "run_ram", "n_row", "filesize"]


def normalise_log(df: DataFrame) -> DataFrame:
    """Map drifted header names onto the canonical ones (coalescing when both exist)."""
    out = df
    for old, new in RUNLOG_RENAMES.items():
        if old in out.columns:
            out = (out.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
                   if new in out.columns else out.withColumnRenamed(old, new))
    return out


def union_logs(logs: list[DataFrame], distinct: bool = True,
               columns: list[str] | None = None) -> DataFrame:
    """Stack logs whose columns differ; missing columns become NULL; duplicates dropped."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                     [normalise_log(d) for d in logs])
    if columns:
        stacked = stacked.select(*[F.col(c) if c in stacked.columns else F.lit(None).alias(c)
                                   for c in columns])
    return stacked.distinct() if distinct else stacked


def stack_logs(logs: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def latest_matching(df: DataFrame, column: str, pattern: str, order: str = "timestamp") -> DataFrame:
    """O3: the latest row whose ``column`` matches ``pattern`` (top-1, no full sort);
    ties go to the largest values of the other columns, in order."""
    others = [F.desc(c) for c in df.columns if c != order]
    return where_matches(df, column, pattern).orderBy(F.desc(order), *others).limit(1)


def runtime_totals(df: DataFrame, keys=("run_env", "run_ram", "action"),
                   value: str = "runtime") -> DataFrame:
    """Total and count of step run times by environment, memory and stage."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total_runtime"),
                                 F.count(F.lit(1)).alias("steps"))


class RunLog:
    """K9: collects one row per timed step; written as one small append."""

    def __init__(self, run_env: str = "local", run_ram: str = ""):
        self.rows: list[tuple] = []
        self.run_env, self.run_ram = run_env, run_ram

    @contextmanager
    def step(self, action: str, n_row: int | None = None, filesize: float | None = None):
        """Time the block; it may set ``n_row`` and ``filesize`` on what it is given, once it knows them."""
        t0 = time.perf_counter()
        known = {"n_row": n_row, "filesize": filesize}
        yield known
        self.rows.append((action, time.perf_counter() - t0, datetime.now(), self.run_env, self.run_ram,
                          *[None if known[c] is None else float(known[c]) for c in ("n_row", "filesize")]))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RUNLOG_SCHEMA)

    def append_to(self, spark: SparkSession, path: str, fmt: str = "csv") -> None:
        """Append the step rows (a handful) as one small file."""
        from hubcast.sources.io import ts_options
        ts_options(self.to_df(spark).coalesce(1).write.mode("append").option("header", True)).format(fmt).save(path)
