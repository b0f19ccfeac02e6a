"""The polling sweep as Structured Streaming: micro-batches of scenes and detections into the store."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from orbweave.operators import store, tracking


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def refresh(spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame], key: str = "obs_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: append what is new, then derive again the sites of the batch.

    Appends ignore known keys, and the sites derived are those of the whole batch, not of what was new in it:
    a batch that runs again after a crash between the two writes appends nothing and still derives.
    A store that cannot be read is an error; only one that is not there counts as empty. Late rows
    are not dropped: the whole history of their sites is derived again and replaces the sites' partitions.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            place = f"{root}/observations"
            fresh = batch.dropDuplicates([key])
            if _there(spark, place):
                fresh = store.insert_ignore(spark.read.schema(batch.schema).parquet(place), batch, [key])
            fresh.write.mode("append").partitionBy("site").parquet(place)
            history = spark.read.schema(batch.schema).parquet(place).join(batch.select("site").distinct(), "site", "left_semi")
            store.write_site(derive(history), f"{root}/derived")
        finally:
            batch.unpersist()

    return run


def new_events(previous: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose id the previous ones lack: what a sweep tells after a batch."""
    return events.join(previous.select("event_id"), "event_id", "left_anti")


_STATE = "tracker binary"
_TOLD = "site string, family string, obs_id string, track_id string, prob double, chosen int, what string"


def stream_tracks(obs: DataFrame, area_m2: float) -> DataFrame:
    """Links as they are made and the ends of tracks, from a stream of sightings.

    State per (site, family) is the tracks that can still be linked. Scenes must arrive whole and in time
    order; for anything else the batch refresh rebuilds a site. ``what`` is ``link`` or the status of a track that ended.
    """

    def run(key, frames, state):
        tracker = pickle.loads(state.get[0]) if state.exists else tracking.Tracker(key[1], area_m2)
        rows = pd.concat(list(frames))
        told = []
        starts = rows.groupby("scene_id")["t"].min().reset_index().sort_values(["t", "scene_id"])
        for scene in starts["scene_id"]:
            own = rows[rows["scene_id"] == scene].sort_values("id").to_dict("records")
            told += [x | {"what": "link"} for x in tracker.feed([tracking.sighting(r) for r in own])]
            told += [{"track_id": c["track_id"], "what": c["status"]} for c in tracker.drained()]
        state.update((pickle.dumps(tracker),))
        frame = pd.DataFrame(told, columns=["obs_id", "track_id", "prob", "chosen", "what"])
        frame.insert(0, "family", key[1])
        frame.insert(0, "site", key[0])
        yield frame.astype({"chosen": "Int32"})

    return tracking.with_errors(obs).groupBy("site", "family").applyInPandasWithState(run, _TOLD, _STATE, "append", GroupStateTimeout.NoTimeout)


def sweep(source: DataFrame, root: str, derive: Callable[[DataFrame], DataFrame], every: str | None = None):
    """Start the sweep over a streaming frame of observations; without ``every`` it takes what there is and ends."""
    writer = source.writeStream.foreachBatch(refresh(source.sparkSession, root, derive)).option("checkpointLocation", f"{root}/_offsets")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per time window, tumbling or sliding; with ``late``, behind a watermark (an extension: late rows drop)."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def alerts(events: DataFrame, least: float = 0.5) -> DataFrame:
    """Messages for events severe enough, most severe first."""
    text = F.format_string("[%.2f] %s: %s at %s", F.col("severity"), F.col("kind"), F.col("event_id"), F.col("site"))
    return events.where(F.col("severity") >= least).orderBy(F.col("severity").desc(), "event_id").select("event_id", text.alias("message"))
