"""Places whose embedding is like that of examples, places whose embedding changed, and a view of embeddings as colours.

An area is a table of cells (``row``, ``col``, a vector). Axes and medians are counted over all cells; only
sums of products, quantiles and the few examples come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators import vectors
from orbweave.operators.change import opened
from orbweave.operators.medians import medians, quantiles
from orbweave.operators.raster import regions
from orbweave.sources.paths import cut

# Thresholds by method, cells of background for the probe, metres around an example that are no find, and
# limits of the change rule.
ALIKE, PROBED, BACKGROUND, OWN_M = 0.7, 0.8, 4000, 150.0
CHANGE_Z, CHANGE_LEAST, CHANGE_AREA_M2, FINE_RES = 3.0, 0.15, 2000.0, 12.0
VIEW_ENDS = (0.02, 0.98)


def score_regions(cells: DataFrame, by: list[str], score: str, keep: Column, least_px: int = 2, top: int = 50) -> DataFrame:
    """Connected regions of the kept cells with their highest cell, highest first: ``label``, ``place``, ``n``, ``peak``, ``row``, ``col``, ``r0``, ``c0``, ``r1``, ``c1``.

    Of equal cells the first in reading order is the peak, of equal regions the one whose peak comes
    first. ``by`` separates images, each with its own ``top``.
    """
    hot = cut(cells.where(keep).select(*by, "row", "col", F.col(score).cast("double").alias("_s")))
    return ranked_regions(regions(hot.select(*by, "row", "col"), by).join(hot.hint("merge"), [*by, "row", "col"]), by, least_px, top)


def ranked_regions(labelled: DataFrame, by: list[str], least_px: int, top: int) -> DataFrame:
    best = F.max_by(F.struct("row", "col"), F.struct(F.col("_s"), -F.col("row"), -F.col("col")))
    found = labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.max("_s").alias("peak"), best.alias("_at"), F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    order = [F.desc("peak"), F.col("_at.row"), F.col("_at.col")]
    large = found.where(F.col("n") >= least_px)
    # Only the first of each image are kept, which the window limits before it shuffles.
    placed = large.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)
    return placed.select(*by, "label", "place", "n", "peak", F.col("_at.row").alias("row"), F.col("_at.col").alias("col"), "r0", "c0", "r1", "c1")


def scored(cells: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, weights: np.ndarray, bias: float | None = None) -> DataFrame:
    """``row``, ``col`` and ``score``: the whitened unit vector's product with ``weights``, through the logistic function if there is a bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = whitened_units(np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(-1, len(mean)), mean, axes)
            s = z @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s if bias is None else 1 / (1 + np.exp(-(s + bias))))], names=["row", "col", "score"])

    known = cells.where(F.col(vector).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), vector)
    return known.mapInArrow(run, "row long, col long, score double")


def whitened_units(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = (x - mean) @ axes
    return z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-9)


def _listed(rows: DataFrame, vector: str) -> np.ndarray:
    return np.array([r[0] for r in rows.where(F.col(vector).isNotNull()).select(vector).collect()], dtype=np.float64)


def find_similar(
    cells: DataFrame,
    vector: str,
    examples: DataFrame,
    res: float,
    negatives: DataFrame | None = None,
    basis: tuple[np.ndarray, np.ndarray] | None = None,
    threshold: float | None = None,
    top: int = 50,
    least_px: int = 2,
) -> tuple[DataFrame, dict]:
    """Regions of cells like the examples (few rows with ``row``, ``col`` and the vector), and figures about the search.

    Vectors are compared in the whitened space of all cells (or of ``basis``), as raw ones share a large
    common part. Up to two examples without counter-examples: cosine to their mean. Else a balanced
    logistic probe, whose background is the ``BACKGROUND`` cells of smallest hash of their place (a bounded
    sample). Regions that come within ``OWN_M`` of an example are its own and no finds; an example without
    a place only teaches. No example is an error.
    """
    positive = _listed(examples, vector)
    if not len(positive):
        raise ValueError("at least one example is needed")
    dims = positive.shape[1]
    mean, axes = basis if basis is not None else vectors.whitener(cells, vector, dims)
    yes = whitened_units(positive, mean, axes)
    no = _listed(negatives, vector) if negatives is not None else np.zeros((0, dims))
    if len(yes) >= 3 or len(no):
        ground = _listed(cells.where(F.col(vector).isNotNull()).orderBy(F.xxhash64("row", "col"), "row", "col").limit(BACKGROUND), vector)
        w, b = vectors.probe(yes, whitened_units(np.vstack([no, ground]), mean, axes))
        score, limit, method = cut(scored(cells, vector, mean, axes, w, b)), PROBED, "probe"
    else:
        middle = yes.mean(axis=0)
        score, limit, method = cut(scored(cells, vector, mean, axes, middle / max(np.linalg.norm(middle), 1e-9))), ALIKE, "cosine"
    limit = limit if threshold is None else threshold
    hot = cut(score.where(F.col("score") >= limit))
    labelled = cut(regions(hot.select("row", "col"), []).join(hot.hint("merge"), ["row", "col"]).withColumnRenamed("score", "_s"))
    reach = max(1, int(OWN_M / res))
    near = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    around = examples.where("row is not null and col is not null").select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"))
    around = around.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).select((F.col("_r") + F.col("_i")).alias("row"), (F.col("_c") + F.col("_j")).alias("col")).distinct()
    own = cut(labelled.join(around, ["row", "col"], "left_semi").select("label").distinct())
    finds = cut(labelled.join(own, "label", "left_anti"))
    middle, n = medians(score, {"s": F.col("score")})["s"]
    area = lambda rows: rows.count() * res * res / 1e6
    facts = {"method": method, "threshold": limit, "examples": len(yes), "cells": n, "background_median": middle, "example_km2": area(labelled.join(own, "label", "left_semi")), "matched_km2": area(finds)}
    return ranked_regions(finds, [], least_px, top), facts


def semantic_change(before: DataFrame, after: DataFrame, vector: str, res: float, k: float = CHANGE_Z, top: int = 40, least_m2: float = CHANGE_AREA_M2) -> tuple[DataFrame, dict]:
    """Regions of cells whose embedding turned, and figures; cells in one of the two only are not compared.

    The distance must stand out by ``k`` robust deviations and by itself; on fine grids single cells are
    opened away; regions of at least ``least_m2`` count.
    """
    cell = lambda rows: rows.select(F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).alias("cell"), vector)
    rows = cut(vectors.changed(cell(before), cell(after), "cell", vector, k, CHANGE_LEAST).select("cell.row", "cell.col", F.col("distance").alias("_s"), "changed"))
    hot = rows.where("changed").select("row", "col")
    hot = cut(opened(hot, []).select("row", "col") if res <= FINE_RES else hot)
    labelled = regions(hot, []).join(rows.drop("changed").hint("merge"), ["row", "col"])
    n, turned = rows.count(), hot.count()
    middle = medians(rows, {"d": F.col("_s")})["d"][0]
    facts = {"median_distance": middle, "changed_km2": turned * res * res / 1e6, "share_changed": turned / max(n, 1)}
    return ranked_regions(labelled, [], max(1, int(-(-least_m2 // (res * res)))), top), facts


def principal_axes(cells: DataFrame, vector: str, dims: int, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``n`` axes of largest spread over all cells, each turned so that its largest part is positive."""
    mean, spread = vectors.moments(cells, vector, dims)
    _, axis = np.linalg.eigh(spread)
    axis = axis[:, ::-1][:, :n]
    return mean, axis * np.sign(axis[np.abs(axis).argmax(axis=0), np.arange(n)])


def embedding_view(cells: DataFrame, vector: str, dims: int, axes: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``row``, ``col`` and three bytes a cell: its place on three principal axes, each stretched between two exact percentiles."""
    mean, axis = axes if axes is not None else principal_axes(cells, vector, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = (np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(-1, len(mean)) - mean) @ axis
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p[:, k]) for k in range(3))], names=["row", "col", "p0", "p1", "p2"])

    known = cells.where(F.col(vector).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), vector)
    return stretched_view(cut(known.mapInArrow(run, "row long, col long, p0 double, p1 double, p2 double")))


def stretched_view(projected: DataFrame) -> DataFrame:
    names = ["p0", "p1", "p2"]
    ends = {(r["name"], r["share"]): r["value"] for r in quantiles(projected, {p: F.col(p) for p in names}, list(VIEW_ENDS)).collect()}

    def byte(p: str) -> Column:
        low, high = ends.get((p, VIEW_ENDS[0]), 0.0), ends.get((p, VIEW_ENDS[1]), 1.0)
        part = (F.col(p) - F.lit(low)) / F.lit(max(high - low, 1e-6))
        return F.floor(F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")

    return projected.select("row", "col", *[byte(p).alias(c) for p, c in zip(names, ("red", "green", "blue"), strict=True)])
