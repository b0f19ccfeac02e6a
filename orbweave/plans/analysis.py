"""Vector queries over ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import vectors
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql
_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_U = "u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v)"


def _table(spark, d):
    return fx.read(spark, d, "embeddings")


@R.add("sc33_mean_unit_vector", f"WITH {_V}, {_U}, m AS (SELECT list([x]) AS none, i, avg(x) AS a FROM (SELECT unnest(u) AS x, unnest(range(64)) AS i FROM u WHERE label = 3) GROUP BY i) SELECT i, round(a / sqrt((SELECT sum(a * a) FROM m)), 6) AS x FROM m", "")
def sc33(spark, d):
    p = vectors.prototype(_table(spark, d).where("label = 3"), "embedding", 64)
    return p.select(F.posexplode("prototype").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@R.add("v2_cosine_to_example", f"WITH {_V}, x AS (SELECT e AS q FROM v WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, x ORDER BY score DESC, vec_id LIMIT 50", "")
def v2(spark, d):
    t = _table(spark, d)
    example = t.where("vec_id = 7").select(F.col("embedding").alias("prototype"))
    return vectors.similar(t, "embedding", example, 50).select("vec_id", F.round("score", 6).alias("score"))


@R.add("v5_changed_cells", "WITH a AS (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.cell, 1 - list_cosine_similarity(a.e, b.e) AS d FROM a JOIN a b ON b.cell = a.cell + 1), m AS (SELECT median(d) AS med FROM p), s AS (SELECT median(abs(d - med)) * CAST(1.4826 AS DOUBLE) AS mad FROM p, m) SELECT cell, round(d, 6) AS distance, round((d - med) / greatest(mad, 0.01), 4) AS z FROM p, m, s WHERE (d - med) / greatest(mad, 0.01) > 1 AND d > 0.15", "")
def v5(spark, d):
    t = _table(spark, d)
    before, after = t.select(F.col("vec_id").alias("cell"), "embedding"), t.select((F.col("vec_id") - 1).alias("cell"), "embedding")
    c = vectors.changed(before, after, "cell", "embedding", k=1.0).where("changed")
    return c.select("cell", F.round("distance", 6).alias("distance"), F.round("z", 4).alias("z"))


@R.add("v1_whitened_similarity")
def v1(spark, d):
    """Cosine to an example in whitened space; eigenvectors come from the driver, so rows only."""
    t = _table(spark, d)
    mean, axes = vectors.whitener(t, "embedding", 64)
    white = vectors.whitened(t, "vec_id", "embedding", mean, axes)
    example = white.where("vec_id = 7").select(F.col("embedding").alias("prototype"))
    return vectors.similar(white, "embedding", example, 50).select("vec_id", F.round("score", 4).alias("score"))


@R.add("v3_probe")
def v3(spark, d):
    """Logistic probe for label 3: all its whitened vectors against a bounded sample of the others, by a hash of their ids; a test holds the scores against NumPy."""
    t = _table(spark, d)
    basis = vectors.whitener(t, "embedding", 64)
    white = vectors.whitened(t, "vec_id", "embedding", *basis).join(t.select("vec_id", "label"), "vec_id")
    unit = white.select("vec_id", "label", vectors.unit(F.col("embedding")).alias("embedding"))
    sample = lambda rows: np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4000).select("embedding").collect()])
    w, b = vectors.probe(sample(unit.where("label = 3")), sample(unit.where("label <> 3")))
    return vectors.probed(unit, "embedding", w, b).select("vec_id", F.round("score", 4).alias("score"))


@R.add("v7_k_means")
def v7(spark, d):
    """Lloyd's iterations depend on the seed rows; a test holds them against NumPy."""
    assigned, _ = vectors.k_means(_table(spark, d), "vec_id", "embedding", 5, 64)
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
