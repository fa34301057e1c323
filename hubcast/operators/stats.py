"""Statistics: percentiles (A15), correlations (A16), histogram and raster (A17,
A18), column profile (A22), z-scores (M5), one-predictor regression (M23).

Global constants (min, max, mean, sd) are scalar subqueries: Spark computes
them once with a partial + final aggregate and inlines the value; no
unpartitioned window and no join is used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75), method: str = "distributed",
                accuracy: int = 10_000) -> DataFrame:
    """Percentiles, one row per probability.

    * ``distributed`` (default): exact, linear interpolation, by refining a
      histogram (``operators.selection``): two scans, no sort, runs when called.
    * ``aggregate``: Spark's exact ``percentile`` aggregate; its final merge
      holds one count per distinct value in one task — fine for low-cardinality
      columns.
    * ``approx``: ``percentile_approx`` (bounded sketch, returns data values).

    Every method leaves out NULL and NaN.
    """
    df = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    if method == "distributed":
        from hubcast.operators.selection import exact_percentiles
        return exact_percentiles(df, col, probs)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    agg = F.percentile(col, arr) if method == "aggregate" else F.percentile_approx(col, arr, accuracy)
    return (df.agg(agg.alias("_p"))
            .select(F.posexplode("_p").alias("_i", "value"))
            .select(F.element_at(arr, F.col("_i") + 1).alias("percentile"),
                    F.col("value").cast("double").alias("value")))


def correlation_triangle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, lower triangle only, long form.

    One pass: all pairwise co-moments in a single ``agg`` (mergeable states),
    then ``stack`` into rows.  Rows lacking a value of a pair are left out of it;
    a constant column has no correlation (null).
    """
    pairs = [(b, a) for a, b in combinations(columns, 2)]  # row var after column var
    spread = lambda c, other: F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c)))
    aggs = [F.try_divide(F.covar_pop(x, y), spread(x, y) * spread(y, x)).alias(f"_c{i}") for i, (x, y) in enumerate(pairs)]
    stack = ", ".join(f"'{x}', '{y}', _c{i}" for i, (x, y) in enumerate(pairs))
    return df.agg(*aggs).selectExpr(f"stack({len(pairs)}, {stack}) AS (term_x, term_y, corr)")


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson", nulls: str = "pairwise") -> DataFrame:
    """Lower triangle in long form, Pearson or Spearman (ties get their average rank).

    One rule for nulls and NaN in both: ``pairwise`` leaves a row out of the
    pairs it lacks a value for, ``listwise`` out of all pairs.  Pearson is one
    aggregate over the rows.  Spearman counts each pair of values once
    (map-side), ranks the distinct values of both sides without a global sort
    (``operators.selection``) and correlates the ranks by their counts.  A
    constant column, or a pair with fewer than two rows, has no correlation (null).
    """
    if method not in ("pearson", "spearman") or nulls not in ("pairwise", "listwise"):
        raise ValueError(f"unknown method {method!r} or rule {nulls!r}")
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    if nulls == "listwise":
        clean = clean.dropna()
    if method == "pearson":
        return correlation_triangle(clean, columns)
    out = None
    for a, b in combinations(columns, 2):
        one = _rank_correlation(clean, b, a)
        out = one if out is None else out.unionByName(one)
    return out


def _rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    from hubcast.operators.selection import mid_ranks
    from hubcast.session import cut_lineage
    pairs = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y"))
                        .agg(F.count(F.lit(1)).alias("n")))
    ranked = pairs
    for side in ("x", "y"):
        counts = pairs.groupBy(side).agg(F.sum("n").alias("m"))
        ranked = ranked.join(mid_ranks(counts, side, "m", f"r{side}").drop("m"), side)
    n = F.sum("n")
    # ranks less their mean: sums stay small against their squares
    middle = pairs.agg(F.sum("n")).scalar()
    rx, ry = F.col("rx") - (middle + 1) / 2, F.col("ry") - (middle + 1) / 2
    top = F.sum(F.col("n") * rx * ry)
    return (ranked.agg(n.alias("n"), top.alias("xy"), F.sum(F.col("n") * rx * rx).alias("xx"), F.sum(F.col("n") * ry * ry).alias("yy"))
            .select(F.lit(x).alias("term_x"), F.lit(y).alias("term_y"),
                    F.when(F.col("n") > 1, F.try_divide("xy", F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))).alias("corr")))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``x`` in ``[lo, hi]``: ``floor((x-lo)/w)``, the top edge
    folded into the last bin; a zero width (constant column) gives bin 0."""
    width = F.try_divide(hi - lo, F.lit(float(bins)))
    raw = F.floor(F.try_divide(x - lo, F.when(width != 0, width)))
    # ``least`` skips NULLs, so the zero-width case is mapped to 0 first.
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def _edge(idx: Column, lo: Column, hi: Column, bins: int) -> Column:
    return (hi - lo) / F.lit(float(bins)) * idx + lo


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram (count per bin, with the bin's left edge)."""
    src = df.where(F.col(col).isNotNull())
    b = src.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = b["lo"], b["hi"]
    idx = bin_index(F.col(col), lo, hi, bins)
    return (src.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn(col, _edge(F.col("bin"), lo, hi, bins)))


def raster(df: DataFrame, x: str, y: str, resolution: int = 100) -> DataFrame:
    """2-D equal-width binning of two columns, count per cell."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = src.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"),
                         F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    x0, x1, y0, y1 = b["x0"], b["x1"], b["y0"], b["y1"]
    out = src.groupBy(bin_index(F.col(x), x0, x1, resolution).alias("x_bin"),
                      bin_index(F.col(y), y0, y1, resolution).alias("y_bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({x: _edge(F.col("x_bin"), x0, x1, resolution),
                            y: _edge(F.col("y_bin"), y0, y1, resolution)})


def raster_pyramid(df: DataFrame, x: str, y: str, resolutions=(10, 100, 500, 1000)) -> DataFrame:
    """A18 at several resolutions from one pass: rows are counted on the finest grid, whose cells are then rolled up.

    Every resolution must divide the finest one, so a coarse cell is a square of
    whole fine cells and its edges are exactly those of the fine ones.  After the
    scan the work follows the cells of the finest grid, not the rows.
    """
    finest = max(resolutions)
    if any(finest % r for r in resolutions):
        raise ValueError("every resolution must divide the finest one")
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = src.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    x0, x1, y0, y1 = b["x0"], b["x1"], b["y0"], b["y1"]
    fine = (src.groupBy(bin_index(F.col(x), x0, x1, finest).alias("fx"), bin_index(F.col(y), y0, y1, finest).alias("fy"))
            .agg(F.count(F.lit(1)).alias("n")))
    levels = F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution")
    step = F.lit(finest) / F.col("resolution")
    cells = (fine.select("fx", "fy", "n", levels)
             .groupBy("resolution", F.floor(F.col("fx") / step).cast("int").alias("x_bin"), F.floor(F.col("fy") / step).cast("int").alias("y_bin"))
             .agg(F.sum("n").alias("n")))
    at = lambda c, lo, hi: (hi - lo) / F.col("resolution").cast("double") * F.col(c) + lo
    return cells.withColumns({x: at("x_bin", x0, x1), y: at("y_bin", y0, y1)})


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sd, min, max per numeric column, typed (long form)."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    stack = ", ".join(f"'{c}', n{i}, m{i}, s{i}, lo{i}, hi{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(
        f"stack({len(columns)}, {stack}) AS (summary, count, mean, stddev, min, max)")


def standard_scale(df: DataFrame, columns: list[str], with_mean: bool = True,
                   with_std: bool = True, suffix: str = "_z") -> DataFrame:
    """M5 (SQL twin of ``StandardScaler``): ``(x - mean) / sd_samp``."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns],
                            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])).scalar()
    out = {}
    for c in columns:
        z = F.col(c)
        if with_mean:
            z = z - stats[f"m_{c}"]
        if with_std:
            z = F.try_divide(z, stats[f"s_{c}"])
        out[c + suffix] = z
    return df.withColumns(out)


def simple_regression(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope, intercept and R² of ``y ~ x`` (optionally per group)."""
    aggs = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).cast("long").alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
