"""Ingest ledger: reruns, changed and broken files, calls that die half-way; replaced partitions."""
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubcast.session import shared_dir
from hubcast.sources import ledger

SCHEMA = T.StructType().add("id", "long").add("name", "string").add("fare", "double").add("at", "timestamp_ntz")


def _put(root, name, text):
    os.makedirs(f"{root}/in", exist_ok=True)
    with open(f"{root}/in/{name}", "w") as f:
        f.write(text)


def _local(path):
    return path.removeprefix("file:")


GOOD = 'id,name,fare,at\n1,"a, b",2.5,2020-01-01T00:00:00.000000\n2,,,\n'


def test_reruns_bad_lines_and_new_files(spark):
    root = _local(shared_dir(spark, "ledger-test"))
    go = lambda **how: ledger.ingest(spark, f"{root}/in", f"{root}/t", SCHEMA, **how)
    assert go() == ledger.Batch(None, 0, 0, 0)
    _put(root, "one file.csv", GOOD)
    _put(root, "empty.csv", GOOD[:16])
    _put(root, "nothing.csv", "")
    assert go() == ledger.Batch(1, 2, 2, 0)
    assert go().number is None
    # the last line is cut off; another has a word for a number, a third a wrong time
    _put(root, "cut.csv", "id,name,fare,at\nx,y,1,\n3,c,1,2020-13-01T00:00:00.000000\n4,d,4.0,2020-01-02T00:00:00.000000\n5,e")
    assert go() == ledger.Batch(2, 1, 1, 3)
    assert sorted(r["id"] for r in ledger.committed(spark, f"{root}/t", SCHEMA).collect()) == [1, 2, 4]
    reasons = {r["line"][:3]: r["reason"] for r in ledger.quarantined(spark, f"{root}/t").collect()}
    assert reasons == {"x,y": "id: not a value of type bigint", "3,c": "at: not a value of type timestamp_ntz", "5,e": "2 values for 4 columns"}
    sizes = {r["path"].rsplit("/", 1)[1]: (r["size"], r["rows"]) for r in ledger.ledger(spark, f"{root}/t").collect()}
    assert sizes["one%20file.csv"] == (len(GOOD), 2) and sizes["empty.csv"] == (16, 0) and "nothing.csv" not in sizes


def test_changed_files_are_refused_or_replace_their_rows(spark):
    root = _local(shared_dir(spark, "ledger-test"))
    go = lambda **how: ledger.ingest(spark, f"{root}/in", f"{root}/t", SCHEMA, **how)
    _put(root, "a.csv", GOOD)
    _put(root, "b.csv", GOOD)
    assert go().rows == 4
    time.sleep(1.1)
    _put(root, "b.csv", GOOD + "9,z,1.0,2020-01-01T00:00:00.000000\n")
    with pytest.raises(ValueError):
        go()
    assert go(replace=True) == ledger.Batch(2, 1, 3, 0)
    assert ledger.committed(spark, f"{root}/t", SCHEMA).count() == 5


def test_a_batch_without_its_commit_is_not_seen_and_written_again(spark):
    root = _local(shared_dir(spark, "ledger-test"))
    _put(root, "a.csv", GOOD)
    # what a call leaves that dies before its commit: rows, but no ledger entry
    spark.range(3).select(F.col("id"), F.lit("ghost").alias("name"), F.lit(1.0).alias("fare"), F.lit(None).cast("timestamp_ntz").alias("at"),
                          F.lit("file:/ghost").alias("source_file")).write.parquet(f"{root}/t/data/batch=1")
    assert ledger.committed(spark, f"{root}/t", SCHEMA).count() == 0
    assert ledger.ingest(spark, f"{root}/in", f"{root}/t", SCHEMA) == ledger.Batch(1, 1, 2, 0)
    assert ledger.committed(spark, f"{root}/t", SCHEMA).where("name = 'ghost'").count() == 0


def test_replaced_partitions_leave_the_others(spark):
    path = shared_dir(spark, "months-test")
    spark.range(20).select("id", (F.col("id") % 4).alias("m")).write.partitionBy("m").mode("overwrite").parquet(path)
    ledger.replace_partitions(spark.createDataFrame([(100, 2)], "id long, m long"), path, ["m"])
    got = {r["m"]: r["n"] for r in spark.read.parquet(path).groupBy("m").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 5, 1: 5, 2: 1, 3: 5}
