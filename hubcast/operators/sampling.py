"""Sampling and splitting: N1–N4, and the development sample (K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row kept independently with probability ``fraction``."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_n(df: DataFrame, n: int, seed: int = 42, sigmas: float = 6.0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniformly at random without replacement.

    The result is the ``n`` rows with the smallest random key ``u = rand(seed)``.
    A plain ``orderBy(u).limit(n)`` sends up to ``n`` rows from *every* task to
    one final task; here rows are first filtered to ``u < t`` with ``t`` chosen
    so that about ``n + sigmas·sqrt(n)`` rows pass, and only those are sorted.

    Two passes over the input: a count, then the filter, whose ~n surviving
    candidates are cached while they are counted so the final sort reads the
    cache.  If fewer than ``n`` pass (probability below 1e-9 at six sigmas) the
    threshold is dropped, so the answer is always exact.  The keys are
    reproducible for a fixed input layout.
    """
    import math
    keyed = df.withColumn("_u", F.rand(seed))
    total = df.count()
    t = (n + sigmas * math.sqrt(max(n, 1)) + 10) / max(total, 1)
    cand = keyed
    if t < 1.0:
        cand = keyed.where(F.col("_u") < F.lit(t)).persist()
        if cand.count() < min(n, total):
            cand.unpersist()
            cand = keyed
    return cand.orderBy("_u").limit(n).drop("_u")


def random_split(df: DataFrame, weights: dict[str, float], seed: int = 42) -> dict[str, DataFrame]:
    """Named disjoint random parts (``randomSplit``)."""
    names = list(weights)
    parts = df.randomSplit([weights[n] for n in names], seed)
    return dict(zip(names, parts))


def hash_split_label(key, weights: dict[str, float], salt: int = 0x2545F491) -> F.Column:
    """N3, layout-independent: part label from a hash band of the key.

    ``pmod(xxhash64(key, salt), 10000)`` is compared against cumulative weight
    bands, so the same key always lands in the same part, whatever the file or
    partition layout.
    """
    c = F.col(key) if isinstance(key, str) else key
    u = F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(10_000))
    total = float(sum(weights.values()))
    expr, acc = None, 0.0
    names = list(weights)
    for name in names[:-1]:
        acc += weights[name] / total
        cond = u < F.lit(int(round(acc * 10_000)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = F.lit(names[-1])
    return last if expr is None else expr.otherwise(last)


def modulo_split_label(key, weights: dict[str, int]) -> F.Column:
    """N3 with integer percentages: bands of ``pmod(key, 1000003) * 7919 % 100``.

    A multiplicative hash that any SQL engine reproduces exactly (the key is
    reduced modulo a prime first, so the product never overflows).
    """
    c = F.col(key) if isinstance(key, str) else key
    u = F.pmod(F.pmod(c.cast("long"), F.lit(1000003)) * F.lit(7919), F.lit(100))
    expr, acc = None, 0
    names = list(weights)
    for name in names[:-1]:
        acc += int(weights[name])
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = F.lit(names[-1])
    return last if expr is None else expr.otherwise(last)


def split_counts(df: DataFrame, label: str = "part") -> DataFrame:
    """Rows per part in one job (label column + group-by)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def development_sample(df: DataFrame, fraction: float = 0.01, cap: int = 30_000,
                       seed: int = 42) -> DataFrame:
    """K4: Bernoulli sample, then at most ``cap`` rows picked at random (top-k)."""
    return sample_n(bernoulli_sample(df, fraction, seed), cap, seed)


def write_development_sample(df: DataFrame, out_dir: str, fraction: float = 0.01, cap: int = 30_000,
                             seed: int = 42) -> dict[str, str]:
    """K4: draw the development sample once (cached), write it as Parquet and CSV."""
    sample = development_sample(df, fraction, cap, seed).persist()
    paths = {"parquet": f"{out_dir.rstrip('/')}/parquet", "csv": f"{out_dir.rstrip('/')}/csv"}
    sample.write.mode("overwrite").parquet(paths["parquet"])
    sample.write.mode("overwrite").option("header", True).csv(paths["csv"])
    sample.unpersist()
    return paths
