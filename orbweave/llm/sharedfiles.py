"""Files of our own formats in a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

from orbweave.llm.runtime import shared_folder


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS, Azure) and the path within it."""
    return fs.FileSystem.from_uri(place)


def new_folder(frame: DataFrame, name: str) -> str:
    """A folder not used before, below ``spark.checkpoint.dir``."""
    return f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table of the shared folder, read again."""
    place = new_folder(frame, name)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)


def discard(frame: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        files, place = opened(folder)
        files.delete_dir(place)
