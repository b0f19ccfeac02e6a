"""An image in overlapping tiles, each worked on by itself, and blended without seams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(place: Column, size: int, patch: int, step: int) -> Column:
    """First lines of the tiles that hold a line: every ``step`` from 0, and one that ends at the last line."""
    size = max(size, patch)
    last = size - patch
    low, high = F.greatest(F.ceil((place - patch + 1) / step), F.lit(0)), F.least(F.floor(place / step), F.lit(last // step))
    regular = F.when(low <= high, F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    return regular if last % step == 0 else F.when(place >= last, F.array_append(regular, F.lit(last).cast("long"))).otherwise(regular)


def feathered(pixels: DataFrame, by: list[str], bands: list[str], height: int, width: int, enhance: Callable[[np.ndarray], np.ndarray], patch: int = 128, overlap: int = 12, scale: int = 1) -> DataFrame:
    """The image (``by``, ``row``, ``col``, ``bands``) that ``enhance`` makes of tiles, ``scale`` times as fine.

    ``enhance`` takes an array (bands, patch, patch), missing pixels as 0, and returns one of patch times scale. Tiles overlap by twice ``overlap``;
    where they meet the result is their mean, weighed by the distance from a tile's edge up to the overlap. A tile is the unit of work
    and its size is fixed, so an image of any size spreads over the cluster. Pixels outside the image are
    left out; an empty image gives an empty result.
    """
    step = patch - 2 * overlap
    if step < 1:
        raise ValueError("tiles must be larger than their overlaps")
    rows = pixels.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(b).cast("double").alias(b) for b in bands])
    dealt = rows.withColumn("_y", F.explode(_starts(F.col("row"), height, patch, step))).withColumn("_x", F.explode(_starts(F.col("col"), width, patch, step)))
    ramp = np.minimum(np.arange(patch * scale) + 1, np.arange(patch * scale)[::-1] + 1)
    weight = np.minimum(np.minimum.outer(ramp, ramp) / max(overlap * scale, 1), 1.0)
    kinds = dict(rows.dtypes)

    def run(key, table):
        y, x = key[-2].as_py(), key[-1].as_py()
        tile = np.zeros((len(bands), patch, patch))
        r, c = table.column("row").to_numpy() - y, table.column("col").to_numpy() - x
        for k, b in enumerate(bands):
            tile[k, r, c] = np.nan_to_num(table.column(b).fill_null(0.0).to_numpy())
        made = np.asarray(enhance(tile), dtype=np.float64)
        if made.shape != (len(bands), patch * scale, patch * scale):
            raise ValueError(f"a tile came back as {made.shape}")
        top, left = min(patch, height - y) * scale, min(patch, width - x) * scale
        at_r, at_c = np.mgrid[y * scale : y * scale + top, x * scale : x * scale + left]
        w = weight[:top, :left]
        same = [pa.array([v.as_py()] * w.size, type=v.type) for v in key[:-2]]
        sums = [pa.array((made[k, :top, :left] * w).ravel()) for k in range(len(bands))]
        return pa.table([*same, pa.array(at_r.ravel()), pa.array(at_c.ravel()), *sums, pa.array(w.ravel())], names=[*by, "row", "col", *bands, "_w"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "row long", "col long", *(f"{b} double" for b in bands), "_w double"])
    made = dealt.groupBy(*by, "_y", "_x").applyInArrow(run, schema)
    return made.groupBy(*by, "row", "col").agg(*[(F.sum(b) / F.sum("_w")).alias(b) for b in bands])
