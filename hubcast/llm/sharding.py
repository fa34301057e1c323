"""Shards of near-equal size by sampled splitters.

Records are ordered by (text key, doc_id), so copies of a text are neighbours.
A size-weighted sample of keys (expected ``sample_keys`` of them, whatever the
input's size) gives quantile boundaries; records are range-partitioned by them.
A range whose bytes exceed its share twice (a text with very many copies, or a
sampling error) is subdivided by a hash of a key written with every record.  Exact totals per range
place every range on a line from 0 to the total; within a range a running sum
places each record, and the shard is the 1/n-th of the line its first byte
falls in.  Sizes of shards therefore differ by less than one record, whatever
the sample was.

Defined cases: a null text has no bytes (size 8); a null doc_id sorts first;
repeated rows are separate records, drawn and subdivided each by its own key;
very long texts are only hashed and measured; extra columns are ignored; an empty table
gives an empty result; with fewer records than shards some shards are empty.
"""

from __future__ import annotations

import bisect

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stage

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, sample_keys: int = 20_000, ranges_per_shard: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per record of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.md5(text)
    # ``row_key`` is written with the table: a key of every record's own, also among equal ones.
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"),
                             # 52 bits of the digest: exact as a double, so ranges can be looked up by value
                             F.conv(F.substring(digest, 1, 13), 16, 10).cast("double").alias("key"),
                             F.conv(F.substring(digest, 14, 15), 16, 10).cast("long").alias("key2"),
                             (F.length(text) + OVERHEAD).cast("long").alias("size"),
                             F.crc32(text).alias("text_crc32")), "shard-keys")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    # Size-weighted sample: a record is drawn with probability size / total * sample_keys.
    spread = F.xxhash64("row_key")
    draw = (F.pmod(spread, F.lit(1 << 52)) / float(1 << 52)) * float(max(total, 1))
    drawn = sorted(r["key"] for r in rows.where(draw < F.col("size") * float(sample_keys)).select("key").collect())
    n_ranges = max(shards * ranges_per_shard, shuffle_width(spark))
    cuts = sorted({drawn[len(drawn) * i // n_ranges] for i in range(1, n_ranges)}) if drawn else []
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    placed = Bucketizer(splits=splits, inputCol="key", outputCol="range_d").transform(rows)
    placed = placed.withColumn("range", F.col("range_d").cast("int")).drop("range_d")
    share = max(total // n_ranges, 1)
    parts = F.greatest(F.lit(1), F.ceil(F.sum("size") / share)).cast("int")
    counted = placed.groupBy("range").agg(F.sum("size").alias("bytes"), parts.alias("parts"))
    over = stage(counted.where(F.col("bytes") > 2 * share).select("range", "parts"), "shard-over")   # at most n_ranges / 2 rows
    placed = (placed.join(F.broadcast(over), "range", "left")
              .withColumn("part", F.pmod(F.xxhash64("row_key", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"))
    cell = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range part (a parameter's worth, not the input's): its place on the line.
    starts = (placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
              .select("range", "part", F.coalesce(F.sum("bytes").over(cell), F.lit(0)).alias("byte0"),
                      F.coalesce(F.sum("n").over(cell), F.lit(0)).alias("row0")))
    order = Window.partitionBy("range", "part").orderBy("key", "key2", "doc_id", "text_crc32", "row_key")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    lined = (placed.withColumn("before", before).withColumn("row", F.row_number().over(order) - 1)
             .join(F.broadcast(starts), ["range", "part"])
             .select("doc_id", "size", "text_crc32",
                     F.floor((F.col("byte0") + F.col("before")).cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int").alias("shard"),
                     (F.col("row0") + F.col("row")).alias("row")))
    lined = stage(lined, "shard-lined")
    firsts = lined.groupBy("shard").agg(F.min("row").alias("first"))
    return (lined.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def splitter_range(cuts: list[float], key: float) -> int:
    """The range a key falls in: what the Bucketizer does, for tests."""
    return bisect.bisect_right(cuts, key)
