"""Line dedup through a sharded minimal perfect hash.

Distinct line keys (128-bit hashes of the normalised line) are counted once:
number of documents and smallest doc_id.  Every shard (a range of the hash) gets
a minimal perfect hash whose slots index three compact arrays: a 32-bit
fingerprint, a document count and the first document.  Documents then *probe*
the arrays: each Arrow batch of documents sends one packed request per shard
(its distinct line hashes with the documents holding them), a shard's arrays
are held once while its requests stream past, and what comes back is, per
document, the hashes of the lines it loses.  No line text is shuffled or joined.

Hot lines: counting is pre-aggregated per task by Spark; a line holding more
than a ``1 / hot_lines`` share of all (line, document) pairs is one of at most
``hot_lines`` lines, so those entries are handed to every task and never sent
to a shard.

Defined cases: a null or empty text is one empty line; a line repeated within a
document counts once for it and is dropped or kept as a whole; rows repeating a
doc_id are one document and keep their lines alike; rows with a null doc_id
are passed through (neither counted nor changed); ties cannot occur (the
smallest id wins); a very long text is split whole, in its batch;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, groups, mix, pieces, record, shard_of, shuffle_width, stage, utf8

MIN_POINTS = 10
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])
_ROUTED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()),
                     ("docs", pa.binary()), ("levels", pa.binary()), ("bits", pa.binary())])
ROUTED = "shard int, kind int, hashes binary, counts binary, docs binary, levels binary, bits binary"
_DROPS = pa.schema([("doc_id", pa.int64()), ("lost", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: levels of collision-free bits, slot = rank of the key's bit."""

    def __init__(self, levels: np.ndarray, words: np.ndarray):
        self.levels, self.words = levels, words
        self.rank = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @staticmethod
    def _place(a, b, level, size):
        return (mix(a ^ mix(b, level), level + 101) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, words, level = [], [], 0
        while len(a):
            size = max(64, -(-2 * len(a) // 64) * 64)
            at = cls._place(a, b, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(size)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            a, b, level = a[~alone], b[~alone], level + 1
        return cls(np.array(levels, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where no level holds it."""
        out = np.full(len(a), -1, np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(a[left], b[left], level, size) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out


def fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(b ^ mix(a, 7), 11).astype(np.uint32)


def line_digests(text: bytes) -> list[bytes | None]:
    """128-bit hash of every line's key, None for lines whose key is too short to matter."""
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip()
        long = len(key) >= 4 * MIN_POINTS or (len(key) >= MIN_POINTS and len(key.decode("utf-8", "replace")) >= MIN_POINTS)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _distinct(text: bytes) -> list[bytes]:
    return [d for d in dict.fromkeys(line_digests(text)) if d is not None]


def _lines(batches):
    for batch in pieces(batches):
        digests, docs = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if doc is not None:
                found = _distinct(text)
                digests += found
                docs += [doc] * len(found)
        pairs = np.frombuffer(b"".join(digests), _PAIR)
        yield record(_LINES, h1=pairs["a"].astype(np.uint64).view(np.int64), h2=pairs["b"].astype(np.uint64).view(np.int64),
                     doc_id=np.array(docs, np.int64))


def _index(batches):
    for shard, table in groups(batches, "shard"):
        a, b = column(table, "h1").view(np.uint64), column(table, "h2").view(np.uint64)
        mph = PerfectHash.build(a, b)
        at = mph.slots(a, b)
        prints, counts, first = np.empty(len(a), np.uint32), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
        prints[at] = fingerprints(a, b)
        counts[at] = np.minimum(column(table, "n_docs"), 2 ** 32 - 1)
        first[at] = column(table, "first")
        yield record(_ROUTED, shard=[shard], kind=[0], hashes=[prints.tobytes()], counts=[counts.tobytes()],
                     docs=[first.tobytes()], levels=[mph.levels.tobytes()], bits=[mph.words.tobytes()])


def _requests(shards: int, hot: dict[bytes, int]):
    def run(batches):
        for batch in pieces(batches, 10_000):
            digests, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None:
                    found = [d for d in _distinct(text) if d not in hot]
                    digests += found
                    docs += [doc] * len(found)
            if not digests:
                continue
            pairs, docs = np.frombuffer(b"".join(digests), _PAIR), np.array(docs, np.int64)
            order = np.lexsort((pairs["b"], pairs["a"]))
            pairs, docs = pairs[order], docs[order]
            start = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            counts = np.diff(np.r_[start, len(pairs)]).astype(np.uint32)
            lines = pairs[start]
            shard = shard_of(lines["a"].astype(np.uint64), shards)
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(lines)]
            ends = np.r_[start, len(pairs)]
            rows = [(int(shard[lo]), 1, lines[lo:hi].tobytes(), counts[lo:hi].tobytes(), docs[ends[lo]:ends[hi]].tobytes(), None, None)
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            yield record(_ROUTED, **dict(zip(_ROUTED.names, zip(*rows, strict=True), strict=True)))
    return run


def _probe(batches):
    shard = mph = prints = counts = first = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                shard = row["shard"]
                mph = PerfectHash(np.frombuffer(row["levels"], np.int64), np.frombuffer(row["bits"], np.uint64))
                prints, counts = np.frombuffer(row["hashes"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                first = np.frombuffer(row["docs"], np.int64)
                continue
            if shard != row["shard"]:
                continue
            lines = np.frombuffer(row["hashes"], _PAIR)
            a, b = lines["a"].astype(np.uint64), lines["b"].astype(np.uint64)
            at = mph.slots(a, b)
            known = (at >= 0) & (prints[at] == fingerprints(a, b)) & (counts[at] >= 2)
            each = np.frombuffer(row["counts"], np.uint32)
            docs = np.frombuffer(row["docs"], np.int64)
            which = np.repeat(np.arange(len(lines)), each)
            lost = known[which] & (first[at[which]] != docs)
            docs, which = docs[lost], which[lost]
            if not len(docs):
                continue
            order = np.argsort(docs, kind="stable")
            docs, which = docs[order], which[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]), len(docs)]
            yield record(_DROPS, doc_id=docs[cuts[:-1]], lost=[lines[which[lo:hi]].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])


def _apply(hot: dict[bytes, int], carry: list[str]):
    def run(batches):
        for batch in pieces(batches, 1000):
            cols = [[], [], [], []]
            for doc, text, lost in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                gone = {part[i:i + 16] for part in lost or () for i in range(0, len(part), 16)}
                lines = text.split(b"\n")
                if doc is None or not (gone or hot):
                    keep = lines
                else:
                    keep = [line for line, d in zip(lines, line_digests(text), strict=True)
                            if d is None or not (d in gone or hot.get(d, doc) != doc)]
                for c, v in zip(cols, (doc, b"\n".join(keep).decode("utf-8", "replace"), len(lines), len(lines) - len(keep)), strict=True):
                    c.append(v)
            done = record(_KEPT, **dict(zip(_KEPT.names, cols, strict=True)))
            yield pa.RecordBatch.from_arrays([*done.columns, *batch.columns[3:]], names=[*_KEPT.names, *carry])
    return run


def dedup_lines(docs: DataFrame, lines_per_shard: int = 1 << 18, hot_lines: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped and the columns ``carry``: one row per row of ``docs``.

    A line whose key (white space stripped, A-Z lower-cased) has at least ten
    code points and is found in two documents or more stays only in the
    document with the smallest id.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    counted = stage(arrow_map(base, _lines, "h1 long, h2 long, doc_id long").groupBy("h1", "h2")
                    .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "lines")
    # Rows that repeat a doc_id are one document, so a line of one document only has first = last.
    counted = counted.withColumn("n_docs", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("n")))
    size = counted.agg(F.count("*").alias("lines"), F.sum("n_docs").alias("pairs")).first()
    shards = max(1, -(-size["lines"] // lines_per_shard))
    hot_rows = counted.where((F.col("n_docs") > 1) & (F.col("n_docs") * hot_lines > (size["pairs"] or 0))).select("h1", "h2", "first").collect()
    hot = {np.array([(r["h1"] & (2 ** 64 - 1), r["h2"] & (2 ** 64 - 1))], _PAIR).tobytes(): r["first"] for r in hot_rows}
    shard = (F.shiftrightunsigned("h1", 32) * shards / F.lit(1 << 32)).cast("int")
    width = min(shards, 4 * shuffle_width(spark))
    index = arrow_map(counted.withColumn("shard", shard).repartition(width, "shard").sortWithinPartitions("shard"), _index, ROUTED)
    asked = arrow_map(base, _requests(shards, hot), ROUTED)
    drops = arrow_map(index.unionByName(asked).repartition(width, "shard").sortWithinPartitions("shard", "kind"), _probe, "doc_id long, lost binary")
    drops = drops.groupBy("doc_id").agg(F.collect_list("lost").alias("lost"))  # bounded by the lines of one document
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), *carry)
    types = dict(whole.dtypes)
    return arrow_map(whole.join(drops, "doc_id", "left").select("doc_id", "text", "lost", *carry), _apply(hot, list(carry)),
                     "doc_id long, text string, n_lines long, n_dropped long" + "".join(f", `{c}` {types[c]}" for c in carry))
