"""Helpers shared by the operators of this package.

* ``stage`` writes an intermediate table into the shared folder named by
  ``spark.checkpoint.dir`` and reads it back, which cuts lineage in a way that
  survives lost executors; shuffle files of the finished write are released.
* ``scratch`` lists the tables staged inside it, ``discard`` deletes one.
* ``groups`` / ``pieces`` stream Arrow batches with bounded memory.
* ``hash_words`` / ``mix`` / ``split_shards`` are the 64-bit hashing used by the
  sharded tables.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.session import checkpoint_root

#: Asks Spark to drop the shuffle files of a query once it has ended.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SCRATCH: list[list[DataFrame]] = []


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(RELEASE_SHUFFLES, "false")
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    finally:
        spark.conf.set(RELEASE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def discard(table: DataFrame) -> None:
    """Delete a table written by ``stage`` that nothing reads any more; one already deleted is no error."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables staged inside the block, in order, for its owner to discard once its result is written."""
    tables: list[DataFrame] = []
    _SCRATCH.append(tables)
    try:
        yield tables
    finally:
        _SCRATCH.pop()


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the Python workers."""
    _ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _ship(spark: SparkSession) -> None:
    """Give the workers this package once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_hubcast_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        name = os.path.join(tempfile.mkdtemp(prefix="hubcast-py-"), "hubcast")
        sc.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._hubcast_shipped = True


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(name: str = "text"):
    """The text as UTF-8 bytes, null as empty (Arrow hands it to Python undecoded)."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def doc_part(modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into at most ``rows`` rows, so Python objects stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` in a stream sorted by it, one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if held and keys[lo] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[lo]
            held.append(batch.slice(int(lo), int(hi - lo)))
    if held:
        yield current, pa.Table.from_batches(held)


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A null-free numeric column as numpy."""
    col = table.column(name)
    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).to_numpy(zero_copy_only=False)


def release_memory() -> None:
    """Give free memory of a reused worker back to the system after a large task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the upper 32 bits; shards are ranges of the hash, so sorted hashes are sorted by shard."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, byte plane by byte plane (runs of equal bytes), compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def rising(x: np.ndarray) -> bytes:
    """A non-decreasing uint64 array as byte planes of its differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)
