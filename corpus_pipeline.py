"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; every stage but the last returns the columns of ``documents``.  Between
stages the documents are written as Parquet in the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubcast.llm.common import discard, doc_part, scratch, stage
from hubcast.llm.decontam import contaminated
from hubcast.llm.langid import UNKNOWN, identify
from hubcast.llm.line_dedup import dedup_lines
from hubcast.llm.packing import pack_documents
from hubcast.llm.simhash import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null text, no letter) go."""
    found = identify(docs, doc_part(4) != 2, carry=("text", "lang", "source", "n_chars"))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document left without any character but white space goes."""
    kept = dedup_lines(docs, carry=("lang", "source")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a written key of their own per row (``row``), since doc_ids may be null or repeat."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest id, null ids last, and among rows of one id any one."""
    keyed = _keyed(docs, "near-duplicate-rows")
    groups = simhash_components(keyed.select(F.col("row").alias("doc_id"), "text"), shingle=3, max_bits=3)
    placed = groups.select(F.col("doc_id").alias("row"), "component_id").join(keyed.select("row", "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = placed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return keyed.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, whatever their id; other rows of the same id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs, "decontamination-rows")
    hits = stage(contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), benchmark, shingle=5, threshold=0.8)
                 .select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return keyed.join(hits, "row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]

#: Language ID and SimHash are not expressible in SQL; run() is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; once a stage's result is written, its input and its intermediate tables are deleted."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES:
        with scratch() as tables:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        for table in spent + tables[:-1]:
            discard(table)
        spent = [docs]
    return docs
