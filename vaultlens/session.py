"""Session and table helpers shared by every query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers touch the path, so any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from the submitter."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vaultlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, in use for checkpoints; only a local session may go without and gets one."""
    context = spark.sparkContext._jsc.sc()
    place = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isDefined():
        return place or context.getCheckpointDir().get()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set")
        place = "file://" + tempfile.mkdtemp(prefix="vaultlens-")
    spark.sparkContext.setCheckpointDir(place)
    return place
