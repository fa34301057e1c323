"""Exact top-k search by inner product, in tiles.

Vectors are dealt evenly to *shards* (matrices in the narrowest integer type that
holds them, sorted by id); the stated queries of a shard make *query blocks*,
which are sent past every shard.  Each tile of a block and a stretch of a shard is
one matrix product inside a task; only the k best of a tile's row are kept,
merged per shard and then per query in two levels of ranks.

Components are quantised to ``floor(scale * x)`` and products are exact: float64
matrix products while the bound on a score is below 2**53, Python integers
(clipped to the range of a long) otherwise.

Defined cases: a null vector, or one holding a null or non-finite component, or
a null id takes no part; vectors of unequal length are compared as if padded
with zeros; rows repeating an id, and equal rows, are rows of their own: each is
a candidate of all other rows, and each query row is answered; ties go to the
smaller id; fewer than k candidates return all; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import arrow_map, record, shuffle_width, stage

HITS = "home long, block int, place int, query_id long, shard long, at int, vec_id long, score long"
_HITS = pa.schema([("home", pa.int64()), ("block", pa.int32()), ("place", pa.int32()), ("query_id", pa.int64()), ("shard", pa.int64()),
                   ("at", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, clipped to the range of a long."""
    top = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, c)]
    if top[0] * top[1] * max(q.shape[1], 1) < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return blocks.clipped(q.astype(object) @ c.astype(object).T)


def _tiles(k: int, stretch: int):
    def run(batches):
        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.array(row["ids"], np.int64)
                m = blocks.unpacked(row["width"], row["matrix"], len(ids))
                if row["home"] < 0:
                    here = row["shard"], ids, m
                    continue
                shard, c_ids, c = here
                places = np.frombuffer(row["places"], np.int32)
                heaps = blocks.Heaps(len(places), k)
                for at in range(0, len(c_ids), stretch):
                    got = _product(m, c[at:at + stretch])
                    allowed = np.ones(got.shape, bool)
                    if row["home"] == shard:
                        own = np.flatnonzero((places >= at) & (places < at + stretch))
                        allowed[own, places[own] - at] = False
                    heaps.offer(got, allowed, at)
                who, where, score = heaps.entries()
                if len(who):
                    yield record(_HITS, home=np.full(len(who), row["home"]), block=np.full(len(who), row["block"], np.int32), place=places[who],
                                 query_id=ids[who], shard=np.full(len(who), shard), at=where, vec_id=c_ids[where], score=score)
    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               scale: int = 256, shard_rows: int = 32768, query_rows: int = 512, stretch: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query.

    ``is_query`` is a condition on ``vec_id``.  A task holds one shard of
    ``shard_rows``, one block of ``query_rows`` and its product with ``stretch`` candidates.
    """
    spark = vectors.sparkSession
    kept = (vectors.where(F.col(id_col).isNotNull() & blocks.usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), blocks.floored(F.col(vector_col), scale).alias("v"))
            .withColumn("marked", F.coalesce(is_query, F.lit(False))))
    shape = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n = max(min(shuffle_width(spark), -(-shape["n"] // 1024)), -(-shape["n"] // shard_rows), 1)
    # Dealt out evenly, whatever the keys: rows of one id, or equal ones, spread like any others.
    shards = stage(arrow_map(kept.repartition(n), blocks.pack_shards(max(shape["d"] or 0, 1), shard_rows), blocks.SHARDS), "topk-shards")
    asked = stage(arrow_map(shards, blocks.marked_blocks(query_rows), blocks.MARKED), "topk-queries")
    # Numbers of the shards: one for shard_rows rows.
    every = shards.select("shard").distinct().agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    cells = asked.drop("labels").withColumn("shard", F.explode(every.scalar()))
    whole = shards.select("shard", F.lit(-1).cast("long").alias("home"), F.lit(-1).alias("block"), "ids", F.lit(None).cast("binary").alias("places"),
                          "width", "matrix")
    dealt = whole.unionByName(cells).repartitionByRange(n, "shard").sortWithinPartitions("shard", "home")
    tiles = arrow_map(dealt, _tiles(k, stretch), HITS)
    best = [F.col("score").desc(), F.col("vec_id"), F.col("shard"), F.col("at")]
    query = ["home", "block", "place"]
    some = Window.partitionBy(*query, F.pmod(F.xxhash64("shard"), F.lit(64))).orderBy(*best)
    last = Window.partitionBy(*query).orderBy(*best)
    return (tiles.withColumn("n", F.row_number().over(some)).where(F.col("n") <= k)
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
