"""Session settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# settings the library's plans rely on; all can be changed on a running session
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where that costs one more shuffle behind the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# A task's rows are bounded by the bytes it reads, not by the number of cores. A shuffled key is a hundred bytes and unfolds into
# a row per calendar bucket, which windows sort; adaptive execution would join partitions up to 64 MB, or a core's share of the table.
# Files are read in pieces of 16 MB, so that a map-side aggregate holds the groups of one piece.
SIZE_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def apply_skew_settings(spark: SparkSession) -> None:
    for name, value in SKEW_SETTINGS.items():
        spark.conf.set(name, value)


def apply_size_settings(spark: SparkSession) -> None:
    for name, value in SIZE_SETTINGS.items():
        spark.conf.set(name, value)


def build_session(app: str = "spendlens", cores: int | str = "*", partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use spark-submit's."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # series tables are small but costly per row: keep their partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for name, value in {**SKEW_SETTINGS, **SIZE_SETTINGS}.items():
        builder = builder.config(name, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable in local mode, where driver and
    executors share one disk; elsewhere the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spendlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
