"""Scratch data goes below the session's shared checkpoint folder."""
from hubcast.session import checkpoint_root, cut_lineage, shared_dir, spread_for_iteration


def test_shared_dirs_are_unique_and_below_checkpoint_root(spark):
    root = checkpoint_root(spark)
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS y")
    out = cut_lineage(df)
    assert out.count() == 100
    assert "LocalCheckpoint" not in out._jdf.queryExecution().toString()


def test_spread_is_one_layout_whatever_the_input(spark):
    from pyspark.sql import functions as F
    def layout(df):
        return sorted(map(tuple, spread_for_iteration(df, 7).select("id", F.spark_partition_id()).collect()))
    assert layout(spark.range(100).coalesce(1)) == layout(spark.range(100).repartition(16))
