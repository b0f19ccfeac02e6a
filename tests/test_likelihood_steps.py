"""The likelihood ratio in steps: the same numbers, in code that is compiled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import tracking
from orbweave.plans import registry

SIDE = "t double, lat double, lon double, length double, axis double, course double, underway boolean, sigma double, length_sigma double, family string, vx double, vy double, v_sigma double"


def side(spark, seed: int, prefix: str):
    rng = np.random.default_rng(seed)
    some = lambda v, p=0.3: None if rng.uniform() < p else v
    rows = [
        (float(rng.uniform(0, 5e5)), 26 + float(rng.normal(0, 1e-3)), 56 + float(rng.normal(0, 1e-3)), some(float(rng.integers(0, 300))), some(float(rng.uniform(0, 180))), some(float(rng.uniform(0, 360)), 0.6), some(bool(rng.uniform() < 0.3)),
         float(rng.uniform(2, 40)), float(rng.uniform(5, 50)), ["vessel", "aircraft", "vehicle", "tank", "other"][i % 5], *[float(v) if i % 2 else None for v in (rng.normal(0, 0.1), rng.normal(0, 0.1), rng.uniform(0, 0.01))])
        for i in range(40)
    ]
    frame = spark.createDataFrame(rows, SIDE)
    return frame.select(*[F.col(c).alias(prefix + c) for c in frame.columns])


def test_steps_give_the_ratio_of_the_whole_expression(spark):
    a = side(spark, 1, "a_")
    a = a.withColumns({f"a_{k}": v for k, v in tracking.family_terms(F.col("a_family")).items()})
    pairs = a.crossJoin(side(spark, 2, "b_"))
    found = tracking.with_likelihood_ratio(pairs.withColumn("whole", tracking.likelihood_ratio(4e8)), 4e8)
    assert set(found.columns) == {*pairs.columns, "whole", "lr"}
    rows = found.select("whole", "lr").collect()
    assert len(rows) == 1600 and sum(r["lr"] > 0 for r in rows) > 300
    assert [r["lr"] for r in rows] == pytest.approx([r["whole"] for r in rows], rel=1e-12)


def test_no_method_of_the_pairs_is_too_long_for_the_compiler(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES["t1_likelihood_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        made = plan.debug().codegenToSeq()
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 3 and max(sizes) < 8000, sizes  # HotSpot leaves longer ones to its interpreter
