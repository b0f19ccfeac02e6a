"""Streaming queries run to their end over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbweave.operators import tracking
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx
from orbweave.sources.paths import shared_folder
from orbweave.streaming import sweep

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _root(spark) -> str:
    return f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"


@R.add("st1_sweep", "SELECT site, track_id, count(*) AS n_obs, round(median(length_m), 1) AS length_m FROM obs GROUP BY 1, 2")
def st1(spark, d):
    """The polling sweep over a file stream: idempotent appends, touched sites derived again."""
    root = _root(spark)
    o = fx.observations(spark, d)
    o.repartition(4, "obs_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    derive = lambda rows: tracking.track_summary(rows, ["site", "track_id"]).select("site", "track_id", "n_obs", "length_m")
    sweep.sweep(stream, f"{root}/out", derive).awaitTermination()
    return spark.read.parquet(f"{root}/out/derived").select("site", "track_id", "n_obs", "length_m")


@R.add("st6_tumbling_days", "SELECT strftime(time, '%Y-%m-%d') AS start, source, count(*) AS n FROM obs GROUP BY 1, 2")
def st6(spark, d):
    o = fx.observations(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    return sweep.windowed_counts(o, "time", ["source"], "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@R.add("st4_new_events", "SELECT event_id, kind FROM ev WHERE time >= TIMESTAMP '2024-01-20' AND severity >= 0.5", "ev")
def st4(spark, d):
    """What a sweep tells after a batch: events that were not there before it."""
    e = fx.site_events(spark, d).where("severity >= 0.5")
    return sweep.new_events(e.where("time < timestamp_ntz '2024-01-20'"), e).select("event_id", "kind")


@R.add("st5_streamed_tracks")
def st5(spark, d):
    """The tracker on a stream, a day's scenes a batch; its links are those of the batch tracker, which a test holds."""
    root = _root(spark)
    o = fx.observations(spark, d)
    # The table is read once and laid out by day; then a feed's days arrive one after the other, each from its own folder.
    o.withColumn("day", F.date_format("time", "yyyy-MM-dd")).repartition("day").write.partitionBy("day").parquet(f"{root}/days")
    days = spark.read.schema(f"{o.schema.toDDL()}, day string").parquet(f"{root}/days")
    for i, day in enumerate(sorted((r["day"] for r in days.select("day").distinct().collect()), key=lambda day: (day is not None, day))):
        days.where(F.col("day").eqNullSafe(F.lit(day))).drop("day").coalesce(1).write.parquet(f"{root}/in/{i:04d}")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    told = sweep.stream_tracks(stream, 4e8).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    # A stream's state keeps its number of partitions, each a task and a store in every batch; groups are few, so two for each core.
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(usual), 2 * spark.sparkContext.defaultParallelism)))
    try:
        running = told.trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    running.awaitTermination()
    return spark.read.parquet(f"{root}/out").where("what = 'link'").select("site", "obs_id", "track_id", "prob", "chosen")
