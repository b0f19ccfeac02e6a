"""The tracker's stream keeps few stores, whatever the session's shuffle partitions."""

import os

from orbweave.plans import registry, stream


def test_a_batch_opens_two_stores_a_core_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "_root", lambda spark: str(tmp_path / "sweep"))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = registry.QUERIES["st5_streamed_tracks"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
        assert rows.where("chosen = 1").count() == 1000  # every event is linked once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([p for p in os.listdir(tmp_path / "sweep/state/state/0") if p.isdigit()]) <= 2 * spark.sparkContext.defaultParallelism
