"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents may be long, so the similarity of an item with
a whole document says nothing.  Items are partitioned by size (number of
distinct word shingles, powers of two); for a size class with upper bound u, a
document is seen as windows of 2u shingles, u apart, in which a contained item
makes up a third or more.  Item and window signatures are one-permutation
MinHash sketches (the smallest hash per bin, ``bins_per_shingle * u`` bins but at
most ``max_bins``, ``permutations`` of them); one equal slot makes a candidate.
A short item's sketch keeps nearly all its shingles, since it has few to be
found by; a long one's is bounded by ``max_bins * permutations``.  With these
parameters a contained item is missed with a probability below 1e-5 for a
single shingle and far below it for longer items.  Candidates are verified by
exact containment of the item's distinct shingles in the whole document.

A window's slot can only equal an item's if the shingle itself is in the item's
signature, so a document's shingles are first tested against all signature
values and only the hits are checked for being their bin's smallest.

The items' signatures are handed to every task; what is handed over is bounded
by ``pass_bytes``, and a larger benchmark is searched in several passes, each
written before the next begins, so that driver and tasks hold one pass's items
at a time.  Equal items are one item with a count.  No document is shuffled:
hot texts or passages cannot gather in one task.

Defined cases: null or empty texts and items match nothing; an item with fewer
words than a shingle is one shingle of all its words, sought among the
documents' shingles of that length; repeated rows each give their pairs; a null
doc_id is returned as such; very long texts are searched whole; extra columns are ignored; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, pieces, record, stage, utf8

PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double, copies long"
_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64()),
                    ("copies", pa.int64())])
_FILTER = 1 << 20


def shingles(text: bytes, length: int) -> list[bytes]:
    """Word shingles in order (A-Z lower-cased, single spaces)."""
    words = text.lower().split()
    if len(words) < length:
        return []
    whole = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    return [whole[s:e] for s, e in zip((ends - lens)[:len(words) - length + 1].tolist(), ends[length - 1:].tolist(), strict=True)]


def _hashes(parts: list[bytes]) -> np.ndarray:
    xxh = xxhash.xxh64_intdigest
    return np.fromiter((xxh(p, 42) for p in parts), np.uint64, len(parts))


class SizeClass:
    """Items of one shingle length and size class: their slots (permutation, value) -> items."""

    def __init__(self, upper: int, bins: int):
        self.upper, self.bins = upper, np.uint64(bins)
        self.slots: dict[tuple[int, int], list[int]] = defaultdict(list)

    def add(self, item: int, hashes: np.ndarray, permutations: int) -> None:
        for p in range(permutations):
            h = np.sort(mix(hashes, p))
            _, first = np.unique(h % self.bins, return_index=True)
            for value in h[first].tolist():
                self.slots[p, value].append(item)

    def candidates(self, p: int, h: np.ndarray, hits: list[int]) -> set[int]:
        """Items with a slot equal to that of a window of the document.

        h: the document's permuted hashes in order; hits: places that may hold a signature value.
        """
        out: set[int] = set()
        u = self.upper
        for i in hits:
            items = self.slots.get((p, int(h[i])))
            if not items or out.issuperset(items):
                continue
            for block in {max(i // u - 1, 0), i // u}:
                window = h[block * u:(block + 2) * u]
                if h[i] == window[window % self.bins == h[i] % self.bins].min():
                    out.update(items)
                    break
        return out


class ContainmentIndex:
    """Signatures and shingles of one pass's items, (name, text) each."""

    def __init__(self, items: list[tuple[object, bytes]], length: int, permutations: int, bins_per_shingle: int, max_bins: int = 512):
        self.permutations = permutations
        self.items: list[tuple[object, int, frozenset[bytes]]] = []
        self.classes: dict[int, dict[int, SizeClass]] = defaultdict(dict)
        for name, text in items:
            k = min(length, len(text.split()))
            parts = frozenset(shingles(text, k)) if k else frozenset()
            if not parts:
                continue
            upper = 1 << (len(parts) - 1).bit_length()
            cls = self.classes[k].setdefault(upper, SizeClass(upper, min(bins_per_shingle * upper, max_bins)))
            cls.add(len(self.items), _hashes(sorted(parts)), permutations)
            self.items.append((name, k, parts))
        self.filters = {k: np.zeros((permutations, _FILTER), bool) for k in self.classes}  # values any class holds
        for k, by_size in self.classes.items():
            for cls in by_size.values():
                for p, value in cls.slots:
                    self.filters[k][p, value & (_FILTER - 1)] = True

    def search(self, text: bytes, threshold: float) -> list[tuple[object, int, int]]:
        """(name, n_shingles, n_shared) of every item contained in the text."""
        out = []
        for k, by_size in self.classes.items():
            parts = shingles(text, k)
            if not parts:
                continue
            hashes, found = _hashes(parts), set()
            for p in range(self.permutations):
                h = mix(hashes, p)
                hits = np.flatnonzero(self.filters[k][p][(h & np.uint64(_FILTER - 1)).astype(np.intp)]).tolist()
                for cls in by_size.values() if hits else ():
                    found |= cls.candidates(p, h, hits)
            held = set(parts) if found else ()
            for i in sorted(found):
                name, _, wanted = self.items[i]
                shared = sum(s in held for s in wanted)
                if shared >= threshold * len(wanted) - 1e-9:
                    out.append((name, len(wanted), shared))
        return out


def _search(index, threshold: float):
    def run(batches):
        for batch in pieces(batches, 1000):
            rows = [(doc, item, n, shared, shared / n, copies)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for (item, copies), n, shared in index.value.search(text, threshold)]
            if rows:
                yield record(_PAIRS, **dict(zip(_PAIRS.names, zip(*rows, strict=True), strict=True)))
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, permutations: int = 3,
                 bins_per_shingle: int = 64, max_bins: int = 512, pass_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: items whose shingles a document holds to ``threshold`` or more."""
    spark = docs.sparkSession
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text"))
                  .groupBy("item_id", "text").agg(F.count("*").alias("copies")), "benchmark-items")
    size = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // pass_bytes))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    found = None
    for n in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        index = spark.sparkContext.broadcast(ContainmentIndex(
            [((r["item_id"], r["copies"]), bytes(r["text"])) for r in part.collect()], shingle, permutations, bins_per_shingle, max_bins))
        hits = arrow_map(base, _search(index, threshold), PAIRS)
        if passes > 1:
            hits = stage(hits, f"contaminated-{n}")
            index.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
