"""Session helpers shared by the operators: cutting lineage and reaching Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a two-column side is broadcast; at about 40 bytes a row this is a bound of 40 MB.
BROADCAST_ROWS = 1_000_000


#: Bytes of one Arrow batch between the JVM and a Python worker; texts differ too much for a bound on rows.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when it was found through the driver's ``sys.path``, and bound batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def release() -> None:
    """Give freed memory back to the system; a reused worker would keep it through the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def tidy(run):
    """``run`` over the batches of a task, with ``release`` at its end."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        release()

    return whole


def tidy_group(run):
    """``run`` over one cogroup, with ``release`` at its end."""

    def whole(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        release()
        return out

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where there is but this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="orbweave-")


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(True)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Mark a narrow frame for broadcast if its counted rows are within ``BROADCAST_ROWS``."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
