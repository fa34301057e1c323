"""Exact order statistics by refining a histogram (A15), and mid-ranks.

Every number has a coarse cell that follows its order: its sign, its binary
exponent and the first bits of its fraction.  One scan counts the values of each
cell, with the cell's least and largest value; there are at most some ten
thousand cells, whatever the data.  The cells that hold the wanted ranks are known from these
counts; if such a cell holds a single value it is the answer.  A second scan
counts the distinct values of the other wanted cells; that table is
then cut into equal ranges again and again, each time keeping the range that
holds the rank, until the range is a single value.  No value is compared
with a list of bounds, nothing is sorted, and no task holds a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubcast.session import cut_lineage

#: Cells of one binary exponent, and ranges of one refinement.
FRACTIONS, RANGES = 32, 4096


def coarse_cell(v: Column) -> Column:
    """A whole number that never falls as the value rises (infinite values have cells of their own)."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1.0)).otherwise(F.abs(v))
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-1074))
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * FRACTIONS)
    # next to a power of two the logarithm may round up or down: the fraction is then -1 or FRACTIONS, still in order
    cell = (exponent + 1100) * (2 * FRACTIONS) + F.greatest(F.lit(-1), F.least(fraction, F.lit(FRACTIONS))) + 2
    cell = F.when(F.abs(v) == float("inf"), F.lit(2300 * 2 * FRACTIONS)).when(v == 0, F.lit(0)).otherwise(cell)
    return F.when(v < 0, -cell).otherwise(cell).cast("long")


def _plain(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select((v + 0.0).alias("v"))   # -0.0 is 0.0


def _counted(values: DataFrame, key: Column, n: Column) -> list:
    """Rows (k, n, least, most) in order of k."""
    return sorted(values.groupBy(key.alias("k")).agg(n.alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect(), key=lambda r: r["k"])


def _place(rows: list, rank: int) -> tuple:
    """The row that holds a 0-based rank, and the rank inside it."""
    for r in rows:
        if rank < r["n"]:
            return r, rank
        rank -= r["n"]
    raise ValueError("rank beyond the values")


def select_ranks(df: DataFrame, col: str, ranks_of) -> tuple[int, dict[int, float]]:
    """(n, value by rank): exact order statistics of a column without nulls and NaN.

    ``ranks_of(n)`` gives the 0-based ranks wanted of n values.  Two scans of ``df``.
    """
    values = _plain(df, col)
    cells = _counted(values, coarse_cell(F.col("v")), F.count(F.lit(1)))
    n = sum(r["n"] for r in cells)
    found, open_ = {}, []
    for rank in sorted(set(ranks_of(n))) if n else []:
        cell, inside = _place(cells, rank)
        if cell["least"] == cell["most"]:
            found[rank] = cell["least"]
        else:
            open_.append((rank, inside, cell["least"], cell["most"]))
    if open_:
        wanted = None
        for least, most in {(x[2], x[3]) for x in open_}:
            inside = F.col("v").between(least, most)
            wanted = inside if wanted is None else wanted | inside
        table = cut_lineage(values.where(wanted).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
        while open_:
            left = []
            ranges = {}
            for rank, inside, least, most in open_:
                if (least, most) not in ranges:
                    width = most / RANGES - least / RANGES
                    piece = F.floor((F.col("v") - least) / width) if width > 0 else F.col("v")
                    piece = F.least(piece.cast("double"), F.lit(float(RANGES - 1))) if width > 0 else piece
                    ranges[least, most] = _counted(table.where(F.col("v").between(least, most)), piece, F.sum("n"))
                row, rest = _place(ranges[least, most], inside)
                if row["least"] == row["most"]:
                    found[rank] = row["least"]
                else:
                    left.append((rank, rest, row["least"], row["most"]))
            open_ = left
    return n, found


def exact_percentiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Percentiles with linear interpolation between order statistics (position (n - 1) * p)."""
    n, at = select_ranks(df, col, lambda n: [f((n - 1) * p) for p in probs for f in (math.floor, math.ceil)])
    rows = []
    for p in probs:
        h = (n - 1) * p
        lo, hi = (at[math.floor(h)], at[math.ceil(h)]) if n else (None, None)
        rows.append((float(p), None if n == 0 else lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)))
    return df.sparkSession.createDataFrame(rows, "percentile double, value double")


def mid_ranks(counts: DataFrame, v: str, n: str, out: str = "rank", max_cell: int = 1_000_000) -> DataFrame:
    """``counts`` (distinct values ``v`` with ``n`` rows each) with the average 1-based rank of each value's rows.

    Values are ordered inside their coarse cells, and cells by running totals over
    the table of cells; a cell with more than ``max_cell`` distinct values is cut
    into equal ranges first, as often as needed, so no task orders more of them.
    """
    cells = counts.withColumn("_c", F.array(coarse_cell(F.col(v).cast("double")).cast("double"))).withColumn("_v", F.col(v).cast("double") + 0.0)
    cells = cut_lineage(cells)
    while True:
        wide = (cells.groupBy("_c").agg(F.count(F.lit(1)).alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
                .where((F.col("k") > max_cell) & (F.col("lo") < F.col("hi"))).drop("k"))
        pieces = wide.collect()    # at most distinct values / max_cell rows
        if not pieces:
            break
        cut = F.broadcast(wide.sparkSession.createDataFrame(pieces, wide.schema))
        width = F.col("hi") / RANGES - F.col("lo") / RANGES
        piece = F.least(F.floor((F.col("_v") - F.col("lo")) / width).cast("double"), F.lit(float(RANGES - 1)))
        piece = F.when(width > 0, piece).otherwise(F.col("_v"))
        cells = cells.join(cut, "_c", "left").withColumn("_c", F.concat("_c", F.array(F.when(F.col("lo").isNotNull(), piece).otherwise(F.lit(0.0))))).drop("lo", "hi")
        cells = cut_lineage(cells)
    totals = cells.groupBy("_c").agg(F.sum(n).alias("_t"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)   # one row a cell
    starts = totals.select("_c", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("_b", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, "_c")
    return ranked.withColumn(out, F.col("_s") + F.col("_b") + (F.col(n) + 1) / 2).drop("_c", "_v", "_b", "_s")
