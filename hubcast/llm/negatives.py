"""Hard-negative mining: for each anchor and positive, the best negatives in a window of scores.

Rows are packed into shards (integer matrices sorted by id).  A tile is the
product of a block of anchors and a stretch of a shard's candidates, computed by
Strassen's recursion on int64 matrices with zero padding: seven products of
halves instead of eight, integer additions, so every score is exact.

Two passes over the tiles.  The first keeps for each anchor a bounded heap of
its best rows of the same label; heaps of tiles merge into one per shard, those
of shards by ranks in two levels, so no task holds an anchor's candidates.  The
positives give windows (``low``/100 to ``high``/100 of the positive's score), and the
second pass keeps for each anchor and positive a heap of the best rows of other
labels inside its window, merged the same way.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; shorter vectors count as padded with zeros; null ids
take part, are never anchors and sort last; rows repeating an id, or equal
rows, are rows of their own: each is a candidate of all others, an anchor is
only kept from itself, and each anchor row is answered; fewer positives or
negatives than asked for are returned as they are, an anchor without either has
no row; a window of a negative positive score is empty; scores beyond a long are
computed with Python integers and clipped; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import arrow_map, record, shuffle_width, stage

MARKS = "array<struct<place int, positive int, low long, high long>>"
HITS = "home long, block int, place int, positive int, anchor_id long, shard long, at int, vec_id long, score long"
_HITS = pa.schema([("home", pa.int64()), ("block", pa.int32()), ("place", pa.int32()), ("positive", pa.int32()), ("anchor_id", pa.int64()), ("shard", pa.int64()),
                   ("at", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _padded(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 8) -> np.ndarray:
    """The product of two integer matrices; recursion ends where a side is at most ``leaf``.

    Odd sides are padded with a row or column of zeros.  Sums and products of
    int64 wrap around modulo 2**64, so a result that fits is exact whatever the
    size of intermediate sums; object matrices are exact at any size.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m | k | n) & 1:
        a, b = _padded(a, 2 * hm, 2 * hk), _padded(b, 2 * hk, 2 * hn)
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * hm, 2 * hn), p1.dtype)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, clipped to the range of a long."""
    top = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (q, c)]
    if top[0] * top[1] * max(q.shape[1], 1) >= 2 ** 63:
        q, c = q.astype(object), c.astype(object)
    return blocks.clipped(strassen(q, np.ascontiguousarray(c.T)))


def _tiles(k: int, stretch: int, in_windows: bool):
    """Hits of the anchor blocks streamed past each shard: ``in_windows`` of other labels, else of the same label."""
    def run(batches):
        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = row["ids"]
                m = blocks.unpacked(row["width"], row["matrix"], len(ids))
                labels = np.frombuffer(row["labels"], np.int64)
                if row["home"] < 0:
                    here = row["shard"], np.array([-1 if x is None else x for x in ids]), np.array([x is None for x in ids]), labels, m
                    continue
                shard, c_ids, c_null, c_labels, c = here
                places = np.frombuffer(row["places"], np.int32)
                if in_windows:
                    index = {int(p): j for j, p in enumerate(places)}
                    windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                    for mark in row["marks"] or ():
                        low, high = windows.setdefault(mark["positive"], (np.full(len(places), 1, np.int64), np.zeros(len(places), np.int64)))
                        low[index[mark["place"]]], high[index[mark["place"]]] = mark["low"], mark["high"]
                else:
                    windows = {0: (None, None)}
                heaps = {w: blocks.Heaps(len(places), k) for w in windows}
                for at in range(0, len(c_labels), stretch):
                    got = scores(m, c[at:at + stretch])
                    same = labels[:, None] == c_labels[None, at:at + stretch]
                    if not in_windows and row["home"] == shard:
                        own = np.flatnonzero((places >= at) & (places < at + stretch))
                        same[own, places[own] - at] = False
                    for w, (low, high) in windows.items():
                        heaps[w].offer(got, ~same & (got >= low[:, None]) & (got <= high[:, None]) if in_windows else same, at)
                for w, heap in heaps.items():
                    who, where, score = heap.entries()
                    if len(who):
                        yield record(_HITS, home=np.full(len(who), row["home"]), block=np.full(len(who), row["block"], np.int32), place=places[who], positive=np.full(len(who), w, np.int32),
                                     anchor_id=[ids[j] for j in who], shard=np.full(len(who), shard), at=where,
                                     vec_id=pa.array(c_ids[where], pa.int64(), mask=c_null[where]), score=score)
    return run


def _best(hits: DataFrame, k: int, spread: int) -> DataFrame:
    """The k best hits of each anchor and positive with their ``rank``, by heaps merged in two levels."""
    key = ["home", "block", "place", "positive"]
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("shard"), F.col("at")]
    some = Window.partitionBy(*key, F.pmod(F.xxhash64("shard"), F.lit(spread))).orderBy(*order)
    last = Window.partitionBy(*key).orderBy(*order)
    return (hits.withColumn("n", F.row_number().over(some)).where(F.col("n") <= k)
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("n"))


def mine_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, shard_rows: int = 32768, anchor_rows: int = 512, stretch: int = 4096,
                   id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` and ``label`` (whole numbers) are expressions over ``vectors``.
    A task holds one shard, one block of anchors and the product of the block
    with ``stretch`` candidates.
    """
    spark = vectors.sparkSession
    kept = (vectors.where(blocks.usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("marked"),
                    blocks.floored(F.col(vector_col), scale).alias("v")).where("label IS NOT NULL"))
    shape = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n = max(min(shuffle_width(spark), -(-shape["n"] // 1024)), -(-shape["n"] // shard_rows), 1)
    # Dealt out evenly, whatever the keys: equal rows and ids spread like any others.
    shards = stage(arrow_map(kept.repartition(n), blocks.pack_shards(max(shape["d"] or 0, 1), shard_rows), blocks.SHARDS), "negative-shards")
    anchors = stage(arrow_map(shards, blocks.marked_blocks(anchor_rows), blocks.MARKED), "negative-anchors")
    # Numbers of the shards: one for shard_rows rows.
    every = shards.select("shard").distinct().agg(F.sort_array(F.collect_list("shard")).alias("shards"))

    def tiles(blocks_of: DataFrame, k: int, in_windows: bool) -> DataFrame:
        cells = blocks_of.withColumn("shard", F.explode(every.scalar()))
        whole = shards.select("shard", F.lit(-1).cast("long").alias("home"), F.lit(-1).alias("block"), "ids", "labels",
                              F.lit(None).cast("binary").alias("places"), "width", "matrix", F.lit(None).cast(MARKS).alias("marks"))
        dealt = whole.unionByName(cells).repartitionByRange(n, "shard").sortWithinPartitions("shard", "home")
        return _best(arrow_map(dealt, _tiles(k, stretch, in_windows), HITS), k, 64)

    found = stage(tiles(anchors.withColumn("marks", F.lit(None).cast(MARKS)), positives, False), "negative-positives")
    score = F.col("score").cast("decimal(38,0)")
    window = F.struct("place", F.col("rank").cast("int").alias("positive"), F.ceil(score * low / 100).cast("long").alias("low"),
                      F.floor(score * high / 100).cast("long").alias("high"))
    # A block's windows: at most anchor_rows * positives of them.
    marked = anchors.join(found.groupBy("home", "block").agg(F.collect_list(window).alias("marks")), ["home", "block"])
    hard = tiles(marked, negatives, True)
    known = found.select("home", "block", "place", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    return (hard.join(known, ["home", "block", "place", "positive"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
