"""Vectors packed into blocks of rows with integer components, for matrix work inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record

SHARDS = "shard long, ids array<long>, labels binary, marked binary, width int, matrix binary"
MARKED = "home long, block int, ids array<long>, labels binary, places binary, width int, matrix binary"
_SHARDS = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("marked", pa.binary()), ("width", pa.int32()),
                     ("matrix", pa.binary())])
_MARKED = pa.schema([("home", pa.int64()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("places", pa.binary()),
                     ("width", pa.int32()), ("matrix", pa.binary())])
LEAST = -2 ** 63
#: Within this bound sums of products of components are exact in 64 bits.
SMALL = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector (array of numbers) is there and all its components are finite numbers."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad


def floored(vector: Column, scale: int) -> Column:
    """Components floor(scale * x) as longs (clipped to their range)."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * float(scale)))


def longest(vectors: DataFrame, col: str) -> int:
    return vectors.agg(F.max(F.size(col)).alias("d")).first()["d"] or 0


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, shorter ones padded with zeros."""
    lens = np.asarray(lists.value_lengths())
    m = np.zeros((len(lens), dim), np.int64)
    m[np.arange(dim) < lens[:, None]] = np.asarray(lists.flatten())
    return m


def packed(m: np.ndarray) -> tuple[int, bytes]:
    """Bytes per component and the bytes of a matrix in the narrowest type that holds it."""
    for kind in (np.int16, np.int32):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return np.dtype(kind).itemsize, m.astype(kind).tobytes()
    return 8, m.tobytes()


def unpacked(width: int, data: bytes, rows: int) -> np.ndarray:
    m = np.frombuffer(data, f"i{width}").astype(np.int64)
    return m.reshape(rows, len(m) // rows if rows else 0)


def safe(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are if 64 bits do for sums of products, else as Python integers."""
    if all(not a.size or (abs(int(a.min())) <= SMALL and abs(int(a.max())) <= SMALL) for a in arrays):
        return arrays
    return tuple(a.astype(object) for a in arrays)


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -2 ** 63, 2 ** 63 - 1).astype(np.int64) if x.dtype == object else x


def row_batches(batches, rows: int):
    """A task's rows as tables of ``rows`` rows, the last one shorter; one in memory at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, rows - n)
            held.append(take)
            n += take.num_rows
            batch = batch.slice(take.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def one_array(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def pack_shards(dim: int, rows: int):
    """Rows (vec_id, label, marked, v) as shards sorted by id, nulls last."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for n, table in enumerate(row_batches(batches, rows)):
            m = matrix(one_array(table, "v"), dim)
            missing = table.column("vec_id").is_null().to_numpy()
            exact = table.column("vec_id").fill_null(0).to_numpy()
            order = np.lexsort((exact, missing))
            width, data = packed(m[order])
            yield record(_SHARDS, shard=[(part << 24) + n], ids=[[None if missing[i] else int(exact[i]) for i in order]],
                         labels=[table.column("label").to_numpy()[order].astype(np.int64).tobytes()],
                         marked=[table.column("marked").to_numpy()[order].astype(np.uint8).tobytes()], width=[width], matrix=[data])
    return run


def marked_blocks(rows: int):
    """The marked rows of each shard, with their places in it, in """
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["ids"]
                m = unpacked(row["width"], row["matrix"], len(ids))
                places = np.flatnonzero(np.frombuffer(row["marked"], np.uint8))
                labels = np.frombuffer(row["labels"], np.int64)
                for at in range(0, len(places), rows):
                    some = places[at:at + rows].astype(np.int32)
                    width, data = packed(m[some])
                    yield record(_MARKED, home=[row["shard"]], block=[at // rows], ids=[[ids[i] for i in some]], labels=[labels[some].tobytes()],
                                 places=[some.tobytes()], width=[width], matrix=[data])
    return run


class Heaps:
    """The k best (score, place) of each of n rows; earlier places win ties.  Fed in order of place."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST, np.int64)
        self.at = np.full((n, k), -1, np.int32)

    def offer(self, got: np.ndarray, allowed: np.ndarray, at0: int) -> None:
        """Merge a tile's scores where ``allowed``; its columns are the places from ``at0`` on."""
        # what a full heap has no room for, and what k others of the tile exceed, is left out first
        better = allowed & ((self.at[:, -1] < 0)[:, None] | (got > self.score[:, -1][:, None]))
        if got.shape[1] > self.k:
            better &= got >= np.partition(np.where(better, got, LEAST), -self.k, axis=1)[:, -self.k][:, None]
        row, col = np.nonzero(better)
        if not len(row):
            return
        s = got[row, col]
        order = np.lexsort((col, ~s, row))      # ~s falls as s rises, without overflow
        row, col, s = row[order], col[order], s[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        new_s, new_at = np.full(self.score.shape, LEAST, np.int64), np.full(self.at.shape, -1, np.int32)
        new_s[row[keep], rank[keep]], new_at[row[keep], rank[keep]] = s[keep], col[keep] + at0
        both, places = np.concatenate([self.score, new_s], axis=1), np.concatenate([self.at, new_at], axis=1)
        order = np.lexsort((~both, places < 0), axis=1)[:, :self.k]
        self.score, self.at = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, score) of all that was kept."""
        row, rank = np.nonzero(self.at >= 0)
        return row, self.at[row, rank], self.score[row, rank]
