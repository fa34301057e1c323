"""SimHash near-duplicates by multi-index hashing.

Texts become 64-bit fingerprints of their word shingles; equal fingerprints
collapse to one node first, so copies cost nothing further.  For a distance of
at most ``max_bits`` = 3 and two 32-bit segments, two linked fingerprints agree
in one segment up to one bit.  A table keeps every node under each segment's
value; every node looks up the Hamming ball of radius 1 around its segments
(33 keys each) and the complete distance of what it fetches is verified.

A key under which very many nodes meet would make the number of pairs grow with
its square.  Keys with more than ``max_bucket`` nodes take an exact linear way
instead: there, two nodes are linked through *meeting points* (below, ``_hubs``)
that only nodes within the distance share, one link per node and point.

Components come from alternating large-star / small-star rounds over the links,
checkpointed in the shared folder; their label is the smallest doc_id.

Defined cases: null or empty texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle are one shingle; repeated rows
are returned each; rows with a null doc_id link like others but give no label
(null if nothing else is reached); very long texts are read whole, their hashes
summed in slices; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubcast.session import cut_lineage

from .common import arrow_map, pieces, record, stage, utf8

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_HALF = 0xFFFFFFFF


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles (repeats included), as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        xxh = xxhash.xxh64_intdigest
        hashes = [xxh(whole[s:e], seed) for s, e in zip((ends - lens)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    h = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo:lo + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    def run(batches):
        for batch in pieces(batches, 1000):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield record(_PRINTS, doc_id=batch.column(0), fp=np.array(fps, np.uint64).view(np.int64))
    return run


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits among ``width``."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _masks(masks: list[int]):
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _segment(seg: int):
    return F.shiftrightunsigned("fp", 32) if seg == 0 else F.col("fp").bitwiseAND(_HALF)


def _links(nodes: DataFrame, max_bits: int, max_bucket: int) -> DataFrame:
    """(u, v) with u < v: enough links for the components of all pairs within the distance."""
    segs = F.array(*[F.struct(F.lit(s).alias("seg"), _segment(s).alias("value")) for s in (0, 1)])
    table = nodes.select("fp", F.explode(segs).alias("at")).select("fp", "at.*")
    sizes = table.groupBy("seg", "value").agg(F.count("*").alias("n"))
    crowded = stage(sizes.where(F.col("n") > max_bucket).select("seg", "value"), "simhash-crowded")
    radius = max_bits // 2
    asks = table.select(F.col("fp").alias("a"), "seg", F.explode(F.transform(_masks(_ball(32, radius)), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    calm = table.withColumnRenamed("fp", "b").join(crowded, ["seg", "value"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = asks.join(calm, ["seg", "value"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_hubs(table, asks, crowded, max_bits, radius))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _hubs(table: DataFrame, asks: DataFrame, crowded: DataFrame, max_bits: int, radius: int) -> DataFrame:
    """Links of all pairs met under crowded keys, in rows linear in the nodes.

    Under one key, a stored node b has distance 0 and an asking node a distance
    d <= radius in this segment; they are linked if the other segments differ in
    at most max_bits - d bits.  Split that allowance: b spreads over its other
    segment's ball of radius 1 (0 if max_bits < 2), a over the rest of it.  They
    meet in a point exactly if they are linked, for whatever meets b's ball
    point at the rest of the allowance is within the distance.  At a point every
    asking node is linked with the smallest stored node, and so are the stored
    ones with each other (two bits at most): the components come out whole.
    """
    other = F.when(F.col("seg") == 0, _segment(1)).otherwise(_segment(0))
    spread = 1 if max_bits >= 2 else 0
    stored = (table.join(crowded, ["seg", "value"], "left_semi")
              .select("seg", "value", F.col("fp").alias("b"), F.explode(F.transform(_masks(_ball(32, spread)), lambda m: other.bitwiseXOR(m))).alias("point")))
    asking = asks.withColumnRenamed("a", "fp").join(crowded, ["seg", "value"], "left_semi")
    own = F.when(F.col("seg") == 0, _segment(0)).otherwise(_segment(1))
    ball = _masks(_ball(32, max_bits - spread))
    for d in range(1, radius + 1):
        ball = F.when(F.bit_count(own.bitwiseXOR(F.col("value"))) == d, _masks(_ball(32, max_bits - spread - d))).otherwise(ball)
    asking = asking.select("seg", "value", F.col("fp").alias("a"), F.explode(F.transform(ball, lambda m: other.bitwiseXOR(m))).alias("point"))
    centre = stored.groupBy("seg", "value", "point").agg(F.min("b").alias("b"))
    met = asking.join(centre, ["seg", "value", "point"]).select("a", "b")
    same = stored.withColumnRenamed("b", "a").join(centre, ["seg", "value", "point"]).select("a", "b")
    return met.unionByName(same).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every linked node's component (star contraction)."""
    edges = cut_lineage(links.select("u", "v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v")
        edges = cut_lineage(small.select(F.col("m").alias("u"), "v").unionByName(
            small.where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3, max_bucket: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    ``max_bits`` up to 3 is covered by two segments with balls of radius 1.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two 32-bit segments with balls of radius 1 cover distances up to 3")
    rows = stage(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), _prints(shingle), "doc_id long, fp long"), "simhash")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(_links(nodes, max_bits, max_bucket))
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labels = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(labels, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
