"""Scans (S1–S9) and sinks.

Readers always take an explicit schema when one is known (no inference pass
over the data).  Writers are plain DataFrame writes executed by the tasks; no
data passes through the driver.  Scratch output goes below the session's
shared checkpoint folder (``hubcast.session.shared_dir``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Text formats for timestamps in CSV / JSON.  The writers'
# defaults keep milliseconds only; these keep microseconds, and readers use the
# same patterns, so a round trip is lossless.
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_LTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# What stands between the packed texts of a row, and for NULL.
PACK_SEP, PACK_NULL = "\u0002", "\u0001"


def ts_options(rw):
    """Apply the microsecond timestamp formats to a reader or writer."""
    return rw.option("timestampNTZFormat", TS_NTZ_FORMAT).option("timestampFormat", TS_LTZ_FORMAT)


# ---------------------------------------------------------------- scans

def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, header: bool = True,
             delimiter: str = ",", infer: bool = False, repartition: int = 0, check_header: bool = False) -> DataFrame:
    """CSV scan.

    * ``schema`` given → typed, lazy, no inference (S1).
    * ``infer=True`` → one extra pass to infer types (S2); avoid at scale.
    * neither → every column a string (S3); type later with :func:`typed`.
    * ``repartition > 0`` → ``repartition(n)`` after the read (S5); where the scan has more
      splits than ``n``, as many parts as it has splits, so no task gets a fixed share of a growing input.
      The rows are dealt in turn, as with ``repartition``; see :func:`spread`.
    """
    reader = ts_options(spark.read.option("header", header).option("sep", delimiter))
    if schema is not None:
        # a schema maps by position; with check_header, a file whose header differs is refused
        reader = reader.schema(schema).option("enforceSchema", not check_header)
    elif infer:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    return spread(df, max(repartition, df.rdd.getNumPartitions())) if repartition > 0 else df


def spread(df: DataFrame, parts: int) -> DataFrame:
    """``repartition(parts)`` with the string columns of a row packed into one text on the way.

    In a shuffled row each string has a word for its place and is padded to whole words, which
    costs more than the text where strings are short.  A row whose texts hold one of the two control
    characters used for that goes as it is.  Same rows, columns and types.  Every column is
    shuffled, also those that are not selected later.
    """
    fields = df.schema.fields
    texts = [i for i, f in enumerate(fields) if f.dataType == T.StringType()]
    if len(texts) < 2:
        return df.repartition(parts)
    flat = df.toDF(*[f"c{i}" for i in range(len(fields))])
    rest = [f"c{i}" for i in range(len(fields)) if i not in texts]
    values = F.array(*[f"c{i}" for i in texts])
    joined = F.concat_ws("", values)
    clash = F.contains(joined, F.lit(PACK_SEP)) | F.contains(joined, F.lit(PACK_NULL))
    dealt = flat.select(*rest, F.when(~clash, F.array_join(values, PACK_SEP, PACK_NULL)).alias("packed"),
                        F.when(clash, values).alias("unpacked")).repartition(parts)
    split = dealt.select(*rest, "unpacked", F.split("packed", PACK_SEP, -1).alias("texts"))
    back = {i: F.coalesce(F.nullif(F.col("texts")[k], F.lit(PACK_NULL)), F.col("unpacked")[k])
            for k, i in enumerate(texts)}
    return split.select(*[back.get(i, F.col(f"c{i}")).alias(f.name, metadata=f.metadata) for i, f in enumerate(fields)])


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """S3: cast string columns on demand; malformed values become NULL (``try_cast``)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def read_json(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON lines scan with a schema (same timestamp formats as the writer)."""
    return ts_options(spark.read.schema(schema)).json(path)


def read_parquet(spark: SparkSession, path, persist: bool = False) -> DataFrame:
    """Parquet scan, lazy or cached."""
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    return df.persist() if persist else df


def file_manifest(spark: SparkSession, path: str, extension: str = "csv", mode: str = "overwrite",
                  out_root: str = "") -> DataFrame:
    """One row per input file: path, name, title (no extension, no '-'),
    size in bytes and GB, and the output path for the chosen mode.

    Uses the ``binaryFile`` source without its ``content`` column, so files are
    listed but never read; one row per file, built by the scan tasks.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}")
             .option("recursiveFileLookup", True).load(path).select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    title = F.regexp_replace(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), "-", "")
    out = (F.concat_ws("/", F.lit(out_root.rstrip("/")), title) if mode == "overwrite"
           else F.lit(out_root.rstrip("/")))
    return files.select(F.col("path").alias("file_path"), name.alias("file_name"), title.alias("title"),
                        F.col("length").alias("file_size"),
                        F.round(F.col("length") / F.lit(1024.0 ** 3), 2).alias("file_gb"),
                        out.alias("out_path"))


def combine_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read CSV files whose columns differ and stack them by name (missing → NULL).

    Each path is an independent lazy scan; the union is a single plan.
    """
    frames = [ts_options(spark.read.option("header", True).option("inferSchema", True)).csv(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def local_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A literal driver-side table (small lookups only)."""
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sinks

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    """K1: Parquet write; ``append`` adds to one dataset, ``overwrite`` replaces."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True,
              compressed: bool = False, rows_per_file: int = 0) -> str:
    """K2: CSV write with header.

    * ``compressed=True`` → gzip at its fastest level, about a third of the bytes; the readers
      tell by the files' names.  Such a file is read by one task, so:
    * ``rows_per_file > 0`` → a task goes on in a new file after so many rows.
    """
    w = ts_options(df.write.mode(mode).option("header", header))
    if compressed:
        w = w.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    if rows_per_file > 0:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines write (microsecond timestamps)."""
    ts_options(df.write.mode(mode)).json(path)
    return path


def write_orc(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """ORC write."""
    df.write.mode(mode).orc(path)
    return path


@dataclass
class IngestResult:
    source: str
    target: str
    ok: bool
    error: str | None
    seconds: float


def ingest_files(spark: SparkSession, sources: list[str], target_for, schema: T.StructType,
                 mode: str = "overwrite") -> list[IngestResult]:
    """K3: convert each CSV source to Parquet; a failing file is recorded and the
    loop continues.  Each iteration is one distributed read→write job; the loop
    itself only walks the (small) list of file names."""
    import time
    results = []
    for src in sources:
        t0 = time.perf_counter()
        target = target_for(src)
        try:
            write_parquet(read_csv(spark, src, schema), target, mode)
            results.append(IngestResult(src, target, True, None, time.perf_counter() - t0))
        except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
            results.append(IngestResult(src, target, False, str(e), time.perf_counter() - t0))
    return results


def ingest_one_job(spark: SparkSession, sources: list[str], target: str, schema: T.StructType,
                   mode: str = "overwrite", partition_by_file: bool = False) -> DataFrame:
    """K3 as a single distributed job: all sources in one CSV scan; optional output
    partition per source file.  A corrupt or missing file fails the job, so no
    rows are lost in silence (``ingest_files`` records a bad file and goes on).
    Returns a per-file row count (the log), computed from the written data."""
    df = ts_options(spark.read.schema(schema).option("header", True)).csv(sources)
    df = df.withColumn("source_file", F.col("_metadata.file_name"))
    w = df.write.mode(mode)
    if partition_by_file:
        w = w.partitionBy("source_file")
    w.parquet(target)
    return spark.read.parquet(target).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def persist_as(df: DataFrame, name: str) -> DataFrame:
    """K5: cache and register under a name."""
    out = df.persist()
    out.createOrReplaceTempView(name)
    return out
