"""Compression of vectors to short codes: one codebook per part of the vector, fitted on all rows.

Vectors are cut into equal parts; each part position has a codebook of entries,
refined in rounds (assign every part to its nearest entry, move each entry to
the floored mean of its parts).  All arithmetic that decides is in exact
integers.

Assignment is spared by norm-of-sum bounds.  The codebooks of all rounds are
kept.  Every part keeps an upper bound of the distance to its own entry and, for
each group of entries, a lower bound of the distance to the others, both with a
stamp: the round in which they were measured.  In round t a bound moves by the
norm of the *net* displacement of the entries between its stamp and t, which is
at most the sum of their drifts round by round; bounds are never re-stamped just
because a round went by.  Only where the bounds overlap is the distance to the
own entry measured, and only for groups still in reach are their entries
rescanned, exactly.

Rows are packed into blocks once, without a shuffle; a round is one pass that
reads blocks with their state and writes them with the new state and the change
of each entry's sum and count (only rows that changed their entry contribute).
What reaches the driver is the sum of these changes: parts * entries * (width +
1) numbers, whatever the input.  Tables of past rounds are deleted.

Defined cases: a vector that is null or holds a null or non-finite component is
dropped; shorter vectors count as padded with zeros to the longest (then to a
multiple of ``parts``); null ids are kept and sort last; repeated ids and rows
are rows of their own (first entries: by id, then by components); with fewer
rows than entries there are as many entries as rows; components beyond 2**26 are
handled with Python integers and errors beyond a long are clipped; extra columns
are ignored; an empty table gives an empty result and empty codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import arrow_map, discard, record, stage

BLOCKS = "ids array<long>, labels array<string>, width int, vectors binary, state binary, change array<decimal(38,0)>"
ROWS = "vec_id long, label string, code string, error long"
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int32()), ("vectors", pa.binary()),
                     ("state", pa.binary()), ("change", pa.list_(pa.decimal128(38, 0)))])
_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


@dataclass(frozen=True)
class Codes:
    rows: DataFrame              # vec_id, label, code, error
    codebooks: list[np.ndarray]  # of each part, entries x width, as integers

    def spelled(self) -> str:
        """All entries' components in decimal, by part, entry and position."""
        return ",".join(str(int(x)) for book in self.codebooks for entry in book for x in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.spelled().encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    x, entries = blocks.safe(x, entries)
    out = np.zeros((len(x), len(entries)), x.dtype)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - entries[None, :, d]) ** 2
    return out


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Bounds:
    """State of one part position of a block: own entry, bounds and the rounds they were measured in."""

    own: np.ndarray        # n, uint8
    upper: np.ndarray      # n, float32, rounded up
    upper_at: np.ndarray   # n, uint8
    lower: np.ndarray      # n x groups, float32, rounded down
    lower_at: np.ndarray   # n x groups, uint8

    @staticmethod
    def split(entries: int, group: int) -> list[slice]:
        return [slice(at, min(at + group, entries)) for at in range(0, entries, group)]

    @classmethod
    def read(cls, data: memoryview, n: int, groups: int) -> Bounds:
        kinds = [(np.uint8, 1), (np.float32, 1), (np.uint8, 1), (np.float32, groups), (np.uint8, groups)]
        at, got = 0, []
        for kind, wide in kinds:
            size = n * wide * np.dtype(kind).itemsize
            got.append(np.frombuffer(data[at:at + size], kind).reshape((n, wide) if wide != 1 or len(got) > 2 else n).copy())
            at += size
        return cls(*got)

    def write(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.own, self.upper, self.upper_at, self.lower, self.lower_at))

    @staticmethod
    def size(n: int, groups: int) -> int:
        return n * (6 + 5 * groups)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def first_assignment(x: np.ndarray, entries: np.ndarray, group: int) -> Bounds:
    d = squared(x, entries)
    own = d.argmin(axis=1)
    n = len(x)
    root = _root(d)
    upper = root[np.arange(n), own]
    root[np.arange(n), own] = np.inf
    lower = np.stack([root[:, g].min(axis=1) for g in Bounds.split(len(entries), group)], axis=1)
    return Bounds(own.astype(np.uint8), _up(upper), np.zeros(n, np.uint8), _down(lower), np.zeros(lower.shape, np.uint8))


def reassign(x: np.ndarray, history: list[np.ndarray], b: Bounds, group: int) -> int:
    """Bring a part's assignment to the last codebook of ``history``; returns how many distances were measured."""
    now = len(history) - 1
    entries = history[now]
    groups = Bounds.split(len(entries), group)
    # Net displacement of every entry since each earlier round, and its largest of each group.
    net = np.stack([_root(((entries - past).astype(object) ** 2).sum(axis=1)) for past in history])
    far = np.stack([net[:, g].max(axis=1) for g in groups], axis=1)
    low = b.lower - far[b.lower_at, np.arange(len(groups))]
    up = b.upper + net[b.upper_at, b.own]
    reach = lambda u, lo: u[:, None] * (1 + 1e-9) + 1e-9 >= lo  # noqa: E731  (room for rounding of the norms)
    rows = np.flatnonzero(reach(up, low).any(axis=1))
    if not len(rows):
        return 0
    xr, old = x[rows], b.own[rows].astype(np.int64)
    a, c = blocks.safe(xr, entries)
    d_old = ((a - c[old]) ** 2).sum(axis=1)
    measured = len(rows)
    close = reach(_root(d_old), low[rows])
    best, d_best = old.copy(), d_old.copy()
    scans = []
    for g, part in enumerate(groups):
        at = np.flatnonzero(close[:, g])
        if not len(at):
            continue
        d = squared(xr[at], entries[part])
        measured += d.size
        j = d.argmin(axis=1)
        dj, e = d[np.arange(len(at)), j], j + part.start
        better = (dj < d_best[at]) | ((dj == d_best[at]) & (e < best[at]))
        best[at[better]], d_best[at[better]] = e[better], dj[better]
        scans.append((g, at, d))
    scanned = np.zeros(close.shape, bool)
    for g, at, d in scans:
        root, own = _root(d), best[at] - groups[g].start
        mine = np.flatnonzero((own >= 0) & (own < d.shape[1]))
        root[mine, own[mine]] = np.inf
        b.lower[rows[at], g] = _down(root.min(axis=1))
        b.lower_at[rows[at], g] = now
        scanned[at, g] = True
    # The entry a row has left belongs to the others of its group from now on.
    left = np.flatnonzero((best != old) & ~scanned[np.arange(len(rows)), old // group])
    g = old[left] // group
    b.lower[rows[left], g] = _down(np.minimum(low[rows[left], g], _root(d_old[left])))
    b.lower_at[rows[left], g] = now
    b.own[rows] = best
    b.upper[rows], b.upper_at[rows] = _up(_root(d_best)), now
    return measured


def _change(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """Change of (count, sums) of each entry, from the rows that changed their entry."""
    moved = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    rows = np.concatenate([np.ones((len(moved), 1), np.int64), x[moved]], axis=1)
    out = np.zeros((entries, rows.shape[1]), blocks.safe(rows)[0].dtype)
    np.add.at(out, new[moved], rows)
    if old is not None:
        np.subtract.at(out, old[moved], rows)
    return out


def _pack(dim: int, rows: int):
    def run(batches):
        for table in blocks.row_batches(batches, rows):
            width, data = blocks.packed(blocks.matrix(blocks.one_array(table, "v"), dim))
            yield record(_BLOCKS, ids=[table.column("vec_id").to_pylist()], labels=[table.column("label").to_pylist()], width=[width],
                         vectors=[data], state=[None], change=[None])
    return run


def _parts_of(row: dict, books: list[np.ndarray], parts: int, group: int):
    """(x, old entries, bounds) of each part of a block after assigning it to the last of ``books``."""
    n = len(row["ids"])
    m = blocks.unpacked(row["width"], row["vectors"], n)
    wide = books[0].shape[2]
    entries = books[0].shape[1]
    groups = len(Bounds.split(entries, group))
    state = memoryview(row["state"]) if row["state"] is not None else None
    for p in range(parts):
        x = np.ascontiguousarray(m[:, p * wide:(p + 1) * wide])
        if state is None:
            yield x, None, first_assignment(x, books[0][p], group)
            continue
        size = Bounds.size(n, groups)
        bounds = Bounds.read(state[p * size:(p + 1) * size], n, groups)
        old = bounds.own.copy()
        reassign(x, [book[p] for book in books], bounds, group)
        yield x, old, bounds


def _round(books: list[np.ndarray], parts: int, group: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                state, change = [], []
                for x, old, bounds in _parts_of(row, books, parts, group):
                    state.append(bounds.write())
                    change.append(_change(x, old, bounds.own, books[0].shape[1]).ravel())
                yield record(_BLOCKS, **{k: [row[k]] for k in ("ids", "labels", "width", "vectors")}, state=[b"".join(state)],
                             change=[[Decimal(int(v)) for v in np.concatenate(change)]])
    return run


def _final(books: list[np.ndarray], parts: int, group: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                digits, error = [], 0
                for p, (x, _, bounds) in enumerate(_parts_of(row, books, parts, group)):
                    a, c = blocks.safe(x, books[-1][p])
                    error = error + ((a - c[bounds.own.astype(np.int64)]) ** 2).sum(axis=1)
                    digits.append(bounds.own)
                hexed = np.stack(digits, axis=1).tobytes().hex()
                codes = [hexed[k:k + 2 * parts] for k in range(0, len(hexed), 2 * parts)]
                yield record(_ROWS, vec_id=row["ids"], label=row["labels"], code=codes, error=blocks.clipped(np.asarray(error)))
    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, group: int = 4,
             block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of all usable rows and the codebooks after ``rounds`` rounds.

    ``entries`` is at most 256 (two hex digits).  ``group`` is the number of
    entries that share a lower bound, ``block_rows`` the rows a task holds at once.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    kept = (vectors.where(blocks.usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                    blocks.floored(F.col(vector_col), scale).alias("v")))
    longest = blocks.longest(kept, "v")
    wide = max(-(-longest // parts), 1)
    dim = wide * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [])
    start = np.zeros((len(first), dim), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r["v"])] = r["v"]
    books = [np.stack([start[:, p * wide:(p + 1) * wide] for p in range(parts)])]
    table = stage(arrow_map(kept, _pack(dim, block_rows), BLOCKS), "code-blocks")
    totals = np.zeros((parts, len(first), wide + 1), object)
    for _ in range(rounds):
        done = stage(arrow_map(table, _round(books, parts, group), BLOCKS), "code-blocks")
        discard(table)
        table = done
        moved = table.select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).where(F.col("x") != 0)
        for r in moved.collect():       # parts * entries * (wide + 1) numbers at most
            totals.flat[r["at"]] += int(r["x"])
        book = books[-1].copy()
        for p in range(parts):
            for e in range(len(first)):
                if totals[p, e, 0]:
                    book[p, e] = [s // totals[p, e, 0] for s in totals[p, e, 1:]]
        books.append(book)
    rows = stage(arrow_map(table, _final(books, parts, group), ROWS), "code-rows")
    discard(table)
    return Codes(rows, list(books[-1]))


def with_label_error(rows: DataFrame, small: int = 100_000) -> DataFrame:
    """``rows`` (label, error) with ``label_error``: the error summed over rows of the same label, nulls together.

    The sums are one row a label; they are broadcast only if at most ``small`` labels exist.
    """
    sums = stage(rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
                 .select("of", F.least(F.col("s"), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")), "code-label-errors")
    side = F.broadcast(sums) if sums.count() <= small else sums
    return rows.join(side, rows["label"].eqNullSafe(side["of"])).drop("of")
