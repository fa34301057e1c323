"""Ingest with a commit ledger (K3, K1, U3): each file once, bad lines set aside, reruns without effect.

One call is one batch: the files not yet committed are converted by one
distributed job into ``<target>/data/batch=<id>``, their bad lines into
``<target>/quarantine/batch=<id>``, and last, as the commit, one ledger row per file goes into
``<target>/ledger/batch=<id>`` (path, size, modification time, rows, bad lines,
schema, time).  Readers take only batches that the ledger names, so a call that
dies half-way leaves nothing visible, and its folders are overwritten by the
next call.  A file counts as committed while its path, size and modification
time are unchanged; a file that has changed since raises, unless ``replace`` is
given, in which case its earlier rows are hidden by the newer commit.

A line is bad if it does not have a value for every column of the schema, or a
value that its column's type cannot hold; it is kept whole with its reason.

Defined cases: no new file: no batch, nothing is written; a file with only a
header is committed with no rows, one without a byte is not listed by Spark and has no entry; a header line is skipped; a missing folder has no files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubcast.session import cut_lineage
from hubcast.sources.io import TS_LTZ_FORMAT, TS_NTZ_FORMAT, ts_options

LEDGER = (T.StructType().add("path", "string").add("size", "long").add("modified", "timestamp").add("rows", "long")
          .add("bad_lines", "long").add("schema", "string").add("committed", "timestamp"))
BAD = "_bad_line"


@dataclass(frozen=True)
class Batch:
    """What one call did: its number (None if there was nothing to do), files, rows and bad lines."""
    number: int | None
    files: int
    rows: int
    bad_lines: int


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """All commits: one row per file and batch."""
    path = f"{target}/ledger"
    schema = T.StructType([*LEDGER.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def listed_files(spark: SparkSession, source: str, pattern: str = "*.csv") -> DataFrame:
    """(path, size, modified, name) of the files below ``source``; contents are not read.

    ``path`` is the file's URI as every scan reports it (``_metadata.file_path``), ``name`` what a reader is given."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
            .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("modified"), F.col("path").alias("name")))


def _reason(line: Column, schema: T.StructType) -> Column:
    """Why a line is bad: the number of its values, or the first column whose type cannot hold its value."""
    cells = F.from_csv(line, F.lit(", ".join(f"`{f.name}` STRING" for f in schema.fields)), {"mode": "PERMISSIVE"})
    values = F.size(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    out = F.when(values != len(schema.fields), F.format_string(f"%d values for {len(schema.fields)} columns", values))
    for f in schema.fields:
        cell = cells[f.name]
        kind = f.dataType.simpleString()
        if kind.startswith("timestamp"):
            form = TS_NTZ_FORMAT if kind == "timestamp_ntz" else TS_LTZ_FORMAT
            fine = F.try_to_timestamp(cell, F.lit(form)).isNotNull()
        else:
            fine = cell.try_cast(f.dataType).isNotNull()
        if kind != "string":
            out = out.when(cell.isNotNull() & ~fine, F.lit(f"{f.name}: not a value of type {kind}"))
    return out.otherwise(F.lit("unreadable"))


def ingest(spark: SparkSession, source: str, target: str, schema: T.StructType, pattern: str = "*.csv", replace: bool = False,
           header: bool = True) -> Batch:
    """Commit the files below ``source`` that the ledger does not have yet, as one batch."""
    if not _exists(spark, source):
        return Batch(None, 0, 0, 0)
    known = ledger(spark, target)
    found = listed_files(spark, source, pattern)
    same = ["path", "size", "modified"]
    new = cut_lineage(found.join(known.select(*same), same, "left_anti"))
    changed = new.join(known, "path", "left_semi").count()
    if changed and not replace:
        raise ValueError(f"{changed} committed files have changed; pass replace=True to take their new rows")
    paths = [r["name"] for r in new.select("name").collect()]     # names only, as the scan itself lists them
    if not paths:
        return Batch(None, 0, 0, 0)
    number = (known.agg(F.max("batch")).first()[0] or 0) + 1
    read = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = (ts_options(spark.read.schema(read).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD))
             .csv(paths).withColumn("source_file", F.col("_metadata.file_path")))
    staged = f"{target}/staged/batch={number}"
    lines.write.mode("overwrite").parquet(staged)      # one read of the text; both sides below come from it
    parsed = spark.read.schema(lines.schema).parquet(staged)
    data, bad = f"{target}/data/batch={number}", f"{target}/quarantine/batch={number}"
    parsed.where(F.col(BAD).isNull()).drop(BAD).write.mode("overwrite").parquet(data)
    (parsed.where(F.col(BAD).isNotNull()).select("source_file", F.col(BAD).alias("line"), _reason(F.col(BAD), schema).alias("reason"))
     .write.mode("overwrite").parquet(bad))
    counts = parsed.groupBy("source_file").agg(F.count_if(F.col(BAD).isNull()).alias("rows"), F.count_if(F.col(BAD).isNotNull()).alias("bad_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    entry = (new.join(counts, new["path"] == counts["source_file"], "left")
             .select(*same, zero("rows"), zero("bad_lines"), F.lit(schema.simpleString()).alias("schema"), F.current_timestamp().alias("committed")))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")
    _delete(spark, staged)
    done = ledger(spark, target).where(F.col("batch") == number).agg(F.count(F.lit(1)).alias("f"), F.sum("rows").alias("r"), F.sum("bad_lines").alias("b")).first()
    return Batch(number, done["f"], done["r"], done["b"])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _visible(spark: SparkSession, target: str, kind: str, schema: T.StructType) -> DataFrame:
    """Rows of ``kind`` in committed batches, of each file only those of its newest commit."""
    schema = T.StructType([*schema.fields, T.StructField("source_file", T.StringType()), T.StructField("batch", T.IntegerType())])
    newest = ledger(spark, target).groupBy(F.col("path").alias("source_file")).agg(F.max("batch").alias("batch"))
    path = f"{target}/{kind}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).join(newest, ["source_file", "batch"], "left_semi")


def committed(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed files, with ``source_file`` and ``batch``."""
    return _visible(spark, target, "data", schema)


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    """The bad lines of all committed files: source_file, line, reason, batch."""
    return _visible(spark, target, "quarantine", T.StructType().add("line", "string").add("reason", "string"))


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; the files of all others stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
