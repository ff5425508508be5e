"""Session settings the library relies on, and the one place that materialises an intermediate."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "plumbline", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that every later reader sees the same rows.

    The directory is the one the cluster names in ``spark.checkpoint.dir``.  Only a local master
    falls back to a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        directory = spark.conf.get("spark.checkpoint.dir", None)
        if directory is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            directory = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(directory)
    return df.checkpoint(eager=True)


#: A side is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


def shuffle_width(df: DataFrame, floor: int = 8, ceiling: int = 4096) -> int:
    """Number of buckets to split ordered work into: follows the session's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(floor, min(ceiling, width))
