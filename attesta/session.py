"""Session defaults used by tests, the benchmark and interactive work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "attesta", **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI arithmetic and adaptive execution.

    Shuffle partitions are left to adaptive coalescing: the configured number is an
    upper bound, so the same code runs on a laptop and on a large cluster.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut.

    The folder is the cluster's spark.checkpoint.dir; only a local session without one gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attesta-"))
    return df.checkpoint()
