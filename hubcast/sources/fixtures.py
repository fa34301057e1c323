"""Trip, firewall and run-log tables derived from the driver's parquet tables.

The original workflow ships no data, only schemas.  These recipes derive tables of the
same shape from ``lineitem`` and ``events`` so that every operator runs over
real, growing input.  The same expressions appear in the DuckDB oracles
(``hubcast.plans.oracles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MINUTE = "CAST((l_orderkey * 37 + l_partkey * 5) % 1440 AS INT)"

# One trip per line item; raw (mixed-case) column names as in the source files.
TRIP_EXPRS = [
    "l_orderkey * 8 + l_linenumber AS trip_id",
    "CASE WHEN l_linestatus = 'O' THEN 'VTS' ELSE 'CMT' END AS vendor_name",
    f"timestampadd(MINUTE, {_MINUTE}, l_shipdate) AS Trip_Pickup_DateTime",
    f"timestampadd(MINUTE, {_MINUTE} + CAST(l_quantity AS INT), l_shipdate) AS Trip_Dropoff_DateTime",
    "CAST(l_suppkey % 8 AS DOUBLE) AS Passenger_Count",
    "(l_quantity - 1) * 2.1E0 AS Trip_Distance",
    "-74.06E0 + (l_partkey % 320) * 0.001E0 AS Start_Lon",
    "40.57E0 + ((l_orderkey * 7 + l_partkey * 3) % 340) * 0.001E0 AS Start_Lat",
    "'1' AS Rate_Code",
    "'0' AS store_and_forward",
    "-74.06E0 + ((l_partkey * 13 + l_suppkey) % 320) * 0.001E0 AS End_Lon",
    "40.57E0 + ((l_orderkey * 11 + l_linenumber) % 340) * 0.001E0 AS End_Lat",
    "CASE l_returnflag WHEN 'A' THEN 'Cash' WHEN 'N' THEN 'CREDIT' ELSE 'No Charge' END AS Payment_Type",
    "l_extendedprice / 1000 AS Fare_Amt",
    "0.5E0 AS surcharge",
    "'0.5' AS mta_tax",
    "l_extendedprice / 1000 * l_discount AS Tip_Amt",
    "0.0E0 AS Tolls_Amt",
    "l_extendedprice / 1000 * (1 + l_tax) - 2 AS Total_Amt",
]


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with the source file's mixed-case column names (plus ``trip_id``)."""
    return table(spark, sf_dir, "lineitem").selectExpr(*TRIP_EXPRS)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with lower-case column names (P1 applied)."""
    from hubcast.operators.clean import lower_columns
    return lower_columns(raw_trips(spark, sf_dir))


FIREWALL_EXPRS = [
    "CAST(event_id AS DOUBLE) AS ident",
    "ts AS logTime",
    "'fw01' AS servername",
    "'TCP' AS protocol",
    "concat('10.0.0.', CAST(user_id % 16 AS STRING)) AS SourceIP",
    "concat('192.168.1.', CAST(event_id % 8 AS STRING)) AS DestinationIP",
    "concat('10.1.0.', CAST(user_id % 5 AS STRING)) AS OriginalClientIP",
    "CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Denied' ELSE 'Establish' END AS Action",
    "CASE WHEN event_type = 'error' THEN '0x80074e20' ELSE '0x0' END AS resultcode",
    "concat('rule-', CAST((user_id + event_id) % 4 AS STRING)) AS rule",
    "CASE event_id % 3 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'HTTPS' ELSE 'DNS' END AS ApplicationProtocol",
    "value AS bytessent",
    "value * 2 AS bytesrecvd",
    "CAST(user_id AS DOUBLE) AS sessionid",
    "CAST(event_id AS DOUBLE) AS connectionid",
]


def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewall log rows, one per event."""
    return table(spark, sf_dir, "events").selectExpr(*FIREWALL_EXPRS)


def runlog_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log, first header variant: ``action, time, n_row, timestamp`` (numbers
    are doubles, as the logs were written); every event that the second one does not have."""
    return (table(spark, sf_dir, "events").where("NOT coalesce(event_type IN ('click', 'purchase'), false)")
            .selectExpr("CASE event_type WHEN 'view' THEN 'Model: Fit' WHEN 'signup' THEN 'Model: Load' ELSE 'Load: file' END AS action", "value AS time",
                        "CAST(user_id AS DOUBLE) AS n_row", "ts AS timestamp"))


def runlog_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log, second header variant: ``action, runtime, timestamp, filesize`` (clicks and purchases)."""
    return (table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
            .selectExpr("CASE event_type WHEN 'click' THEN 'Write: file' ELSE 'Write: model' END AS action", "value AS runtime",
                        "ts AS timestamp", "CAST(event_id AS DOUBLE) AS filesize"))


def runlog_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log with environment and memory, one step per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "CASE event_type WHEN 'view' THEN 'Model: Fit' WHEN 'click' THEN 'Write: file' ELSE 'Load: file' END AS action",
        "value AS runtime", "ts AS timestamp", "CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'laptop' END AS run_env",
        "CASE WHEN event_id % 3 = 0 THEN '10G' ELSE '1G' END AS run_ram", "CAST(event_id % 5 * 10000 AS DOUBLE) AS n_row")
