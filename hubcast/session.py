"""Session defaults and the shared scratch location.

Defaults: UTC session zone, ANSI mode, adaptive query execution with partition
coalescing and skew-join splitting, Spark UI off.  Scratch data (round trips,
checkpoints, stream sinks) always goes below ``spark.checkpoint.dir`` — the
shared folder a cluster names; a private temporary folder is only created when
that setting is absent (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "hubcast",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    in local mode (tests) is a private folder created when it is unset; on a
    cluster a machine-local folder would not be visible to other executors, so
    an unset setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="hubcast-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder, made through Hadoop's file system."""
    path = f"{checkpoint_root(spark)}/hubcast/{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread_for_iteration(df, partitions: int | None = None, rows_per_partition: int = 250_000):
    """One fixed layout for the input of an iterative fit.

    Iterative fits (k-means) cache their input and scan it once per iteration.
    Start points and sums follow the layout, so it depends on the data alone,
    never on the cluster: rows are dealt by a hash of all columns and sorted, in
    ``partitions`` parts, or one for every ``rows_per_partition`` rows (8 at
    least).  The same data give the same model on any number of cores.  Select
    the columns of the fit first: every column given is shuffled.
    """
    if partitions is None:
        partitions = max(8, -(-df.count() // rows_per_partition))
    columns = [c for c, kind in df.dtypes if kind not in ("map", "variant")]
    return df.repartition(partitions, *columns).sortWithinPartitions(*columns)
