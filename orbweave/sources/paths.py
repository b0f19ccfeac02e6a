"""Where intermediate data goes."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it was found through the driver's ``sys.path``."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where there is but this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="orbweave-")


def ensure_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and go on from there.

    A table read back has the size of its files. A checkpointed frame would keep the estimate of its plan, in which
    every join multiplies; in loops that cut each round such estimates grow to numbers of thousands of digits.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context not in _places:
        _places.clear()
        _places[context] = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    place = f"{_places[context]}/{uuid.uuid4().hex}"
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


#: The folder of the running session's cut frames.
_places: dict = {}
