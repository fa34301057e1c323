"""Order statistics, ranks, raster pyramids, many centres and hashed features against plain Python."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubcast.ml import hashed
from hubcast.operators import selection, stats
from hubcast.operators.centre_index import assign_nearest
from hubcast.operators.hubs import nearest_hub

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0,
        math.nextafter(2.0, 0), math.nextafter(2.0, 3), 0.5, math.nextafter(0.5, 0), 4.0, -4.0, 1e16, 1e16 + 2, 3.0, 3.0]


def test_coarse_cells_follow_the_order(spark):
    rng = random.Random(1)
    values = HARD + [rng.choice([-1, 1]) * math.ldexp(rng.random() + 0.5, rng.randrange(-1073, 1023)) for _ in range(3000)]
    values += [s * math.nextafter(math.ldexp(1.0, e), side) for e in range(-1022, 1023, 7) for s in (1, -1) for side in (0, math.inf)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.coarse_cell(F.col("v") + 0.0).alias("c")).collect()
    cells = [r["c"] for r in sorted(rows, key=lambda r: r["v"])]
    assert cells == sorted(cells)


@pytest.mark.parametrize("values", [HARD, [1.0] * 999 + [1.0000000001], [float(i % 3) for i in range(1000)], [1 + i * 1e-9 for i in range(5000)], [7.5], []])
def test_every_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double")
    want = sorted(values)
    ranks = sorted({0, 1, len(want) // 3, len(want) // 2, len(want) - 1} & set(range(len(want))))
    n, got = selection.select_ranks(df, "x", lambda n: ranks)
    assert n == len(want) and got == {r: want[r] for r in ranks}


def test_percentiles_of_no_rows_and_whole_numbers(spark):
    assert [r["value"] for r in stats.percentiles(spark.createDataFrame([], "x long"), "x", (0.5,)).collect()] == [None]
    df = spark.range(1, 102).withColumnRenamed("id", "x")
    assert [r["value"] for r in stats.percentiles(df, "x", (0.0, 0.005, 1.0)).collect()] == [1.0, 1.5, 101.0]


def _mid_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + 1 + Fraction(order.count(v) - 1, 2) for v in set(values)}


@pytest.mark.parametrize("max_cell", [1_000_000, 3])
def test_mid_ranks(spark, max_cell):
    rng = random.Random(2)
    values = [rng.choice([rng.randrange(40) / 8, 1 + rng.randrange(50) * 1e-7, -rng.random()]) for _ in range(600)]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    got = {r["v"]: r["rank"] for r in selection.mid_ranks(counts, "v", "n", max_cell=max_cell).collect()}
    assert got == {v: float(r) for v, r in _mid_ranks(values).items()}


def _spearman(pairs):
    a, b = ([_mid_ranks([p[i] for p in pairs])[p[i]] for p in pairs] for i in (0, 1))
    return float(np.corrcoef([float(x) for x in a], [float(x) for x in b])[0, 1])


@pytest.mark.parametrize("rule", ["pairwise", "listwise"])
def test_correlations_with_gaps(spark, rule):
    rng = random.Random(4)
    rows = [(rng.randrange(4) * 1.0, rng.choice([None, math.nan, rng.random()]), rng.choice([None, rng.randrange(9) * 1.0, 2.0]), 5.0) for _ in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    known = lambda v: v is not None and v == v
    for method in ("pearson", "spearman"):
        got = {(r["term_x"], r["term_y"]): r["corr"] for r in stats.correlation_matrix(df, list("abck"), method, rule).collect()}
        for x, y in got:
            i, j = "abck".index(x), "abck".index(y)
            kept = [(r[i], r[j]) for r in rows if known(r[i]) and known(r[j]) and (rule == "pairwise" or all(map(known, r)))]
            if "k" in (x, y):
                assert got[x, y] is None
            else:
                want = _spearman(kept) if method == "spearman" else float(np.corrcoef(*zip(*kept, strict=True))[0, 1])
                assert abs(got[x, y] - want) < 1e-9
    with pytest.raises(ValueError):
        stats.correlation_matrix(df, ["a", "b"], "kendall")


def test_pyramid_levels_are_sums_of_the_finest(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 991 / 10).alias("x"), (F.col("id") * 71 % 877 / 7).alias("y"))
    levels = {}
    for r in stats.raster_pyramid(df, "x", "y", (5, 10, 50)).collect():
        levels.setdefault(r["resolution"], {})[r["x_bin"], r["y_bin"]] = r["n"]
    fine = {(r["x_bin"], r["y_bin"]): r["n"] for r in stats.raster(df, "x", "y", 50).collect()}
    assert levels[50] == fine
    for res in (5, 10):
        want = {}
        for (i, j), n in fine.items():
            want[i * res // 50, j * res // 50] = want.get((i * res // 50, j * res // 50), 0) + n
        assert levels[res] == want
    with pytest.raises(ValueError):
        stats.raster_pyramid(df, "x", "y", (7, 10))
    flat = stats.raster_pyramid(df.limit(9).withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0)), "x", "y", (2, 4)).collect()
    assert sorted((r["resolution"], r["x_bin"], r["n"]) for r in flat) == [(2, 0, 9), (4, 0, 9)]


@pytest.mark.parametrize("side,rows", [(None, 5_000_000), (3, 0), (40, 5_000_000)])
def test_many_centres_equal_the_expression(spark, side, rows):
    rng = random.Random(6)
    centres = [(rng.choice([rng.random() * 3, rng.gauss(1, 0.01)]), rng.random() * 2) for _ in range(150)] + [(1.5, 1.0), (1.5, 1.0)]
    points = [(rng.uniform(-2, 5), rng.uniform(-2, 4)) for _ in range(2000)] + centres + [(3e5, -7.0)]
    df = spark.createDataFrame(points, "start_lon double, start_lat double")
    got = assign_nearest(df, centres, side=side, broadcast_rows=rows).withColumn("want", nearest_hub("start_lon", "start_lat", centres))
    assert got.where("cluster <> want OR cluster IS NULL").count() == 0 and got.count() == len(points)
    one = assign_nearest(df, [(0.0, 0.0)]).agg(F.max("cluster")).first()[0]
    assert one == 0
    missing = spark.createDataFrame([(None, 1.0)], "start_lon double, start_lat double")
    assert assign_nearest(missing, centres).first()["cluster"] is None


def test_hashed_features_of_a_million_levels(spark):
    n = 1_000_000
    df = spark.range(n).select(F.concat(F.lit("10."), F.col("id").cast("string")).alias("ip"), (F.col("id") % 2).cast("string").alias("side"))
    model = hashed.hashed_kmeans(["ip", "side"], k=2, width=1 << 12, init_mode="random").fit(df)
    assert not any(hasattr(s, "labels") for s in model.stages)          # no list of levels anywhere
    assert sum(model.stages[-1].summary.clusterSizes) == n
    assert model.transform(df).groupBy("cluster").count().count() == 2
