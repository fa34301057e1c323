"""Katz backoff models of any order in stored tables, and scores of any text from them.

``train`` counts the n-grams of the highest order once; each lower order is
their sum over the first word, so a gram's suffix is always in the table below.
With c(h) the sum of c(h w) over w, d Good-Turing discounts per order, and ``unknown``
the mass that the single words leave (as in ``katz``, which is this model at order
two, packed for one corpus)::

    P(w | h) = d(c(h w)) c(h w) / (c(h) + 1)   if c(h w) > 0
             = a(h) P(w | h')                  otherwise   (h' is h without its first word; a = 1 for unseen h)

A model is a folder: ``grams/n=k`` (``w1 .. wk``, count, probability),
``contexts/n=k`` (``w1 .. w(k-1)``, count, a) and ``constants``.  ``score`` descends
the orders: distinct n-grams look for their row; those without one take
their context's weight and ask the next table for their distinct suffixes.

Joins run between tables of distinct grams or against a side with one row per key,
so a frequent gram adds to one side only and adaptive execution splits it.

Words are 64-bit hashes.  Defined cases: null and empty texts are the end token
alone; very long texts are cut into windows in bounded batches; repeated rows
count and are scored each; rows whose ``learn`` is null are not learned from;
without training text every token has probability one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.session import checkpoint_root

from .common import arrow_map, pieces, stage, utf8
from .katz import K, START, discounts, tokens

BATCH_ROWS = 1 << 16


def _names(first: int, last: int) -> list[str]:
    return [f"w{i}" for i in range(first, last + 1)]


def _windows(docs: DataFrame, order: int) -> DataFrame:
    """(row, doc_id, w1 .. wn): one row per token of ``docs`` (row, doc_id, text as bytes), with the words before it."""
    names = ["row", "doc_id", *_names(1, order)]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def flush(held):
        size = np.array([len(w) - order + 1 for _, _, w in held])
        ids = [pa.array(x, pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), size))) for x in list(zip(*held, strict=True))[:2]]
        words = [pa.array(np.concatenate([w[i:len(w) - order + 1 + i] for _, _, w in held])) for i in range(order)]
        return pa.RecordBatch.from_arrays(ids + words, schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in pieces(batches, 500):
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                padded = np.concatenate([np.full(order - 1, START, np.uint64), tokens(text)]).view(np.int64)
                for lo in range(0, len(padded) - order + 1, BATCH_ROWS):
                    held.append((row, doc, padded[lo:lo + BATCH_ROWS + order - 1]))
                    n += len(held[-1][2])
                    if n >= BATCH_ROWS:
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)
    return arrow_map(docs, run, ", ".join(f"{n} long" for n in names))


def _kept(mass: list[float]) -> Column:
    """Discounted count of ``c``."""
    by_count = F.array(*[F.lit(float(d)) for d in mass])
    return F.col("c") * F.when(F.col("c") <= K, F.get(by_count, (F.col("c") - 1).cast("int"))).otherwise(1.0)


class BackoffModel:
    """A trained model: constants, and tables read from its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/constants").first()
        self.order, self.tokens, self.words, self.unknown = row["order"], row["tokens"], row["words"], row["unknown"]

    def grams(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/grams/n={k}")

    def contexts(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/contexts/n={k}")


def _small_counts(counts: DataFrame) -> list[int]:
    found = {r["c"]: r["count"] for r in counts.where(F.col("c") <= K + 1).groupBy("c").count().collect()}
    return [found.get(r, 0) for r in range(1, K + 2)]


def train(docs: DataFrame, learn: Column, order: int = 3, folder: str | None = None) -> BackoffModel:
    """Model of the rows where ``learn`` holds, written to ``folder`` (by default below the shared checkpoint folder)."""
    if order < 1:
        raise ValueError("the order is at least one")
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/llm/katz-model-{uuid.uuid4().hex[:12]}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    none = F.lit(0).cast("long")
    used = docs.where(F.coalesce(learn, F.lit(False))).select(none.alias("row"), none.alias("doc_id"), utf8().alias("text"))
    counts = {order: stage(_windows(used, order).groupBy(*_names(1, order)).agg(F.count("*").alias("c")), "katz-counts")}
    for k in range(order - 1, 0, -1):
        suffix = [F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, k + 1)]
        counts[k] = stage(counts[k + 1].select(*suffix, "c").groupBy(*_names(1, k)).agg(F.sum("c").alias("c")), "katz-counts")

    total, distinct = counts[1].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    small = _small_counts(counts[1])
    mass = discounts(small)
    unknown = (1 + sum((1 - d) * r * n for r, (d, n) in enumerate(zip(mass, small, strict=False), 1))) / (total + 1)
    below = written(counts[1].withColumn("p", _kept(mass) / (total + 1)), "grams/n=1")
    for k in range(2, order + 1):
        mass = discounts(_small_counts(counts[k]))
        history = _names(1, k - 1)
        lower = below.select(*[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, k)], F.col("p").alias("q"))
        sums = (counts[k].join(lower, _names(2, k)).groupBy(*history)
                .agg(F.sum("c").alias("n"), F.sum(_kept(mass)).alias("kept"), F.sum("q").alias("q")))
        weight = (F.col("n") + 1 - F.col("kept")) / (F.col("n") + 1) / (1 - F.col("q"))
        contexts = written(sums.select(*history, "n", weight.alias("a")), f"contexts/n={k}")
        seen = counts[k].join(contexts.select(*history, "n"), history)
        below = written(seen.select(*_names(1, k), "c", (_kept(mass) / (F.col("n") + 1)).alias("p")), f"grams/n={k}")
    written(spark.createDataFrame([(order, total, distinct, unknown)], "order int, tokens long, words long, unknown double").coalesce(1), "constants")
    return BackoffModel(spark, folder)


def _resolve(model: BackoffModel, asked: DataFrame, k: int) -> DataFrame:
    """(w1 .. wk, lp): log10 probability of the last word after the others, for distinct grams."""
    names = _names(1, k)
    found = asked.join(model.grams(k).select(*names, "p"), names, "left")
    if k == 1:
        return found.select("w1", F.log10(F.coalesce("p", F.lit(model.unknown))).alias("lp"))
    found = stage(found, f"katz-asked-{k}")
    seen = found.where(F.col("p").isNotNull()).select(*names, F.log10("p").alias("lp"))
    unseen = found.where(F.col("p").isNull()).select(*names)
    shorter = [F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, k)]
    lower = _resolve(model, unseen.select(*shorter).distinct(), k - 1)
    lower = lower.select(*[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, k)], F.col("lp").alias("rest"))
    weighed = unseen.join(model.contexts(k).select(*names[:-1], "a"), names[:-1], "left").join(lower, names[1:])
    return seen.unionByName(weighed.select(*names, (F.log10(F.coalesce("a", F.lit(1.0))) + F.col("rest")).alias("lp")))


def score(model: BackoffModel, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row per row of ``docs``, which need not have been trained on.

    ``base_score`` is the add-one model of single words, as in ``katz``.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), "katz-rows")
    names = _names(1, model.order)
    last = names[-1]
    asked = stage(_windows(rows, model.order).select(*names).distinct(), "katz-grams")
    words = model.grams(1).select(F.col("w1").alias(last), "c")
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.tokens + model.words + 1)))
    facts = (_resolve(model, asked, model.order).join(words, last, "left")
             .select(*names, "lp", F.col("c").isNotNull().cast("long").alias("known"), base.alias("base")))
    return (_windows(rows, model.order).join(stage(facts, "katz-facts"), names).groupBy("row", "doc_id")
            .agg(F.count("*").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
            .drop("row"))
