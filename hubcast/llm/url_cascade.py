"""Url filters by a cascade of Bloom filters, in DataFrame expressions only.

A rule is a host and a path prefix (``example.com/de/``); it fits its host and
all subdomains where the path starts with the rule's, and the longest fitting
rule wins.  Every url therefore has a set of *candidate keys*: suffixes of its
host with prefixes of its path.  The distinct candidate keys of the whole corpus
are the key universe.

A cascade answers exactly, for every key of the universe, whether it is listed:
level 1 is a Bloom filter of the listed keys, level 2 one of the unlisted keys
that pass level 1, level 3 one of the listed keys that pass level 2, and so on
until nothing passes wrongly.  A key is listed if the first level it fails is an
even one (or it passes all of an odd number).  Level 1 lets through about 0.7
times as many false positives as there are listed keys, the others half of what
they are asked, so a cascade takes a few bits a listed key.  A second cascade,
over the listed keys, says which of them block.

Judging is one pass over the pages without a join or a shuffle: the bits come
in as a scalar subquery, and each url probes its own candidate keys.  The bits
of one pass are bounded by ``max_bytes``; longer lists are cut by a hash of the
key into sections, one pass each, and the longest match of all sections wins.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; a rule that is null or empty takes no part; a rule without ``/``
has an empty path prefix and fits every path; of one rule listed with both
verdicts the block holds; of fitting rules equally long the one with the longer
host wins; repeated pages are judged one by one; a very long host costs no more
than the longest host of a rule, since longer suffixes cannot be listed; extra
columns are ignored; an empty table gives an empty result and an empty list the
default everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one bitmap of ``bitmap_construct_agg``.
BUCKET = 32768


@dataclass(frozen=True)
class Level:
    number: int    # from 1
    first: int     # its first byte in the cascade's bits
    size: int      # bits
    hashes: int

    def positions(self, key: Column) -> list[Column]:
        """Places of a key's bits, by double hashing with hashes of this level's own."""
        h = F.shiftrightunsigned(F.xxhash64(F.lit(2 * self.number), key), 2)
        step = F.shiftrightunsigned(F.xxhash64(F.lit(2 * self.number + 1), key), 34)
        return [F.pmod(h + step * j, F.lit(self.size).cast("long")) for j in range(self.hashes)]

    def passes(self, key: Column, bits: Column, first: int | None = None) -> Column:
        """Whether all bits of a key are set; ``first`` where ``bits`` is not the whole cascade."""
        start = (self.first if first is None else first) + 1
        out = None
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + start).cast("int"), F.lit(1))), 16, 10).cast("int")
            on = F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1
            out = on if out is None else out & on
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    bitmaps: DataFrame | None    # at, bits: pieces of BUCKET bits in order

    def bits(self) -> Column:
        """All levels' bits as one value, gathered once for a query."""
        return _joined(self.bitmaps) if self.levels else F.lit(None).cast("binary")

    def holds(self, key: Column, bits: Column) -> Column:
        """Whether a key of the universe is listed; exact for these, arbitrary for other keys."""
        if not self.levels:
            return F.lit(False)
        out = F.when(~self.levels[0].passes(key, bits), F.lit(False))
        for level in self.levels[1:]:
            out = out.when(~level.passes(key, bits), F.lit(level.number % 2 == 0))
        return out.otherwise(F.lit(len(self.levels) % 2 == 1))


def _joined(bitmaps: DataFrame) -> Column:
    return bitmaps.agg(F.expr("listagg(bits) WITHIN GROUP (ORDER BY at)")).scalar()


def _hashes(inside: int, outside: int, number: int) -> int:
    """log2 of a level's inverse false-positive rate."""
    return min(30, max(1, math.ceil(math.log2(outside / (inside * math.sqrt(0.5)))))) if number == 1 and outside else 1


def build_cascade(keys: DataFrame, name: str) -> Cascade:
    """The cascade of ``keys`` (key string, listed boolean; each key once, the whole universe)."""
    spark = keys.sparkSession
    levels: list[Level] = []
    pieces: DataFrame | None = None
    first = 0
    open_keys = keys
    while True:
        number = len(levels) + 1
        encoded = F.col("listed") == F.lit(number % 2 == 1)
        n = open_keys.agg(F.count_if(encoded).alias("inside"), F.count_if(~encoded).alias("outside")).first()
        if not n["inside"]:
            return Cascade(tuple(levels), pieces)
        hashes = _hashes(n["inside"], n["outside"], number)
        level = Level(number, first, max(8, math.ceil(n["inside"] * hashes / math.log(2))), hashes)
        buckets = -(-level.size // BUCKET)
        set_bits = open_keys.where(encoded).select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
        # One bit a bucket is always set, so no piece of the bitmap can be missing.
        set_bits = set_bits.unionByName(spark.range(buckets).select((F.col("id") * BUCKET).alias("p")))
        bitmap = stage(set_bits.groupBy(F.shiftright("p", 15).alias("bucket"))
                       .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(BUCKET - 1).cast("long"))).alias("bits"))
                       .select((F.col("bucket") + first // (BUCKET // 8)).alias("at"), "bits"), f"{name}-bits")
        levels.append(level)
        pieces = bitmap if pieces is None else pieces.unionByName(bitmap)
        first += buckets * (BUCKET // 8)
        if not n["outside"]:
            return Cascade(tuple(levels), pieces)
        # What is encoded stays in play, of the others only what passes; the next level takes the others' side.
        passed = open_keys.withColumn("b", _joined(bitmap)).where(encoded | level.passes(F.col("key"), F.col("b"), first=0))
        open_keys = stage(passed.select("key", "listed"), f"{name}-open")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, key, blocks) of the usable rules, each key once."""
    text = F.col("rule")
    host = F.translate(F.substring_index(text, "/", 1), UPPER, LOWER)
    path = F.substring(text, F.length(host) + 1, F.length(text))
    return (rules.where(text.isNotNull() & (text != "") & F.col("verdict").isin("allow", "block"))
            .select(host.alias("host"), path.alias("path"), F.concat(host, path).alias("key"), (F.col("verdict") == "block").alias("blocks"))
            .groupBy("host", "path", "key").agg(F.max("blocks").alias("blocks")))


def candidate_keys(host: Column, path: Column, longest_host: int, path_lengths: list[int]) -> Column:
    """All (n, h, key) a rule could have that fits: length, length of the host, host suffix with path prefix."""
    tail = F.right(host, F.lit(longest_host + 1))
    labels = F.size(F.split(tail, r"\.", -1))
    suffixes = F.filter(F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", tail, F.lit("."), -i)),
                        lambda s: F.length(s) <= longest_host)
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    made = F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(
        (F.length(s) + n).alias("n"), F.length(s).alias("h"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key"))))
    return F.flatten(made)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               max_bytes: int = 8 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``.

    ``rules`` has ``rule`` and ``verdict`` (``allow`` or ``block``).  ``default``
    is the verdict where no rule fits.  ``max_bytes`` bounds the bits a task
    holds at once.
    """
    host, path = host_and_path(F.col(url_col))
    hosted = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = stage(rule_table(rules), "url-rules")
    # Lengths only: as many as the longest rule has characters.
    shape = listed.agg(F.max(F.length("host")).alias("host"), F.sort_array(F.collect_set(F.length("path"))).alias("paths"),
                       F.count("*").alias("n")).first()
    nothing = F.lit(None).cast("struct<n int, h int, key string, blocks boolean>")
    if not shape["n"]:
        return hosted.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape["host"], shape["paths"])
    seen = hosted.select(F.explode(F.transform(keys, lambda c: c["key"])).alias("key"), F.lit(True).alias("seen"),
                         F.lit(False).alias("listed"), F.lit(False).alias("blocks"))
    named = listed.select("key", F.lit(False).alias("seen"), F.lit(True).alias("listed"), "blocks")
    universe = stage(seen.unionByName(named).groupBy("key")
                     .agg(*[F.max(c).alias(c) for c in ("seen", "listed", "blocks")])
                     .where("seen").select("key", "listed", "blocks"), "url-keys")
    n = universe.agg(F.count_if("listed").alias("in"), F.count_if(~F.col("listed")).alias("out")).first()
    # Level 1, and about four bits a key for the other levels and the second cascade.
    size = n["in"] * (_hashes(n["in"], n["out"], 1) / math.log(2) + 4) / 8 if n["in"] else 0
    sections = max(1, math.ceil(size / max_bytes))
    rows = hosted.withColumn("best", nothing)
    for section in range(sections):
        mine = (lambda key, s=section: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(sections).cast("long")) == s) if sections > 1 else (lambda key: F.lit(True))
        part = universe.where(mine(F.col("key")))
        member = build_cascade(part.select("key", "listed"), "url-listed")
        blocking = build_cascade(part.where("listed").select("key", F.col("blocks").alias("listed")), "url-blocking")
        rows = (rows.withColumn("b1", member.bits()).withColumn("b2", blocking.bits())
                .withColumn("hit", F.array_max(F.filter(keys, lambda c: mine(c["key"]) & member.holds(c["key"], F.col("b1")))))
                .withColumn("hit", F.when(F.col("hit").isNotNull(), F.struct(
                    F.col("hit.n").alias("n"), F.col("hit.h").alias("h"), F.col("hit.key").alias("key"),
                    blocking.holds(F.col("hit.key"), F.col("b2")).alias("blocks"))))
                .select("page_id", "host", "path", F.greatest("best", "hit").alias("best")))
        if sections > 1:
            rows = stage(rows, "url-judged")
    verdict = F.when(F.col("best.blocks"), F.lit("block")).when(~F.col("best.blocks"), F.lit("allow")).otherwise(F.lit(default))
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
