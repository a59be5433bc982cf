"""The folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def use_shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, in use for checkpoints.  Only a local session may go without: it gets one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not place:
        set_ = context._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            return set_.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        place = "file://" + tempfile.mkdtemp(prefix="vaultlens-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(place)
    return place


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{use_shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles and checkpoints that nothing refers to; it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Forget what the process keeps for the token store, and return memory that isn't in use to the system."""
    sys.modules.pop("_vaultlens_process", None)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which a worker that other operators used before, and will again, begins and ends without their memory or its own."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
