"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors within a squared distance d of each other have, after any rotation, at least one block
of coordinates in which they are within the block's share of d. Each block is range-joined by
itself (slabs of the block's reach along one coordinate, then exact block distances), and every
pair that some block proposes is verified on the whole vectors. A pair that several blocks
propose counts for the first of them only, so links are counted where they are found and pairs
are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.graph import components
from orbweave.llm.near_dedup import _forest
from orbweave.llm.runtime import cut, ready, table, tidy
from orbweave.llm.sortedgroups import whole_groups

BLOCKS = 4
#: Vectors of one side that a task holds; larger slabs are compared tile by tile.
TILE = 16_384
_SLACK = 1e-5


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray) -> np.ndarray:
    """Rows turned by the rotation of their width; a row's result does not depend on its neighbours."""
    turn = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return out


def block_bounds(dims: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dims)
    cuts = [dims * b // n for b in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budgets(dims: int, threshold: float) -> list[float]:
    """Squared distance each block may take: its share of dimensions, and a little for rounding."""
    return [(2 - 2 * threshold + _SLACK) * (hi - lo) / dims for lo, hi in block_bounds(dims)]


def _rows(column: pa.Array, dtype) -> list[np.ndarray | None]:
    """Usable vectors; None for null, zero, and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or not len(x.values) or x.values.null_count:
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(dtype)
        norm = float(np.sqrt((v.astype(np.float64) ** 2).sum())) if np.isfinite(v).all() else 0.0
        out.append(v if 0 < norm < np.inf else None)
    return out


def _packed(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = [None if v is None else v.tobytes() for v in _rows(part.column(1), dtype)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, type=pa.binary())], names=["id", "vector"])

    return tidy(run)


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _slabs(dtype: str, threshold: float):
    """For every vector and block: the slab along the block's first coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            dims = np.array([len(x) // np.dtype(dtype).itemsize for x in raw])
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                z = rotated(_units([raw[i] for i in own], dtype))
                ids = batch.column("id").take(pa.array(own))
                for b, ((lo, _), most) in enumerate(zip(block_bounds(int(d)), budgets(int(d), threshold), strict=True)):
                    slab = np.floor(z[:, lo] / math.sqrt(most)).astype(np.int32)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(n, d, dtype=np.int32)), pa.array(np.full(n, b, dtype=np.int32)), pa.array(slab)], names=["id", "dims", "block", "slab"]
                    )

    return tidy(run)


def _verified(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, za: np.ndarray, zb: np.ndarray, block: int, bounds, most, threshold: float) -> np.ndarray:
    """Of pairs (a[i], b[i]), those that link and that no earlier block proposes."""
    keep = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        good = (ua[x] * ub[y]).sum(axis=1) >= threshold
        gap = (za[x] - zb[y]) ** 2
        inside = np.stack([gap[:, lo:hi].sum(axis=1) <= m for (lo, hi), m in zip(bounds, most, strict=True)], axis=1)
        keep[at : at + 50_000] = good & inside[:, block] & ~inside[:, :block].any(axis=1)
    return keep


def _joined(dtype: str, threshold: float):
    keys = ["dims", "block", "slab", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_groups(batches, keys):
            for s, e in zip(at[:-1], at[1:], strict=True):
                g = batch.slice(s, e - s)
                dims, block = g.column("dims")[0].as_py(), g.column("block")[0].as_py()
                bounds, most = block_bounds(dims), budgets(dims, threshold)
                lo, hi = bounds[block]
                side = g.column("side").to_numpy()  # 0: left, 1: right, 2: both
                ids, weight = g.column("id").to_numpy(), g.column("n").to_numpy()
                unit = _units(g.column("vector").to_pylist(), dtype)
                z = rotated(unit)
                near = np.ascontiguousarray(z[:, lo:hi], dtype=np.float32)
                square = (near * near).sum(axis=1)
                left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                links, labels = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
                whole = bool((side == 2).any())
                for p in range(0, len(left), 256):
                    rows = left[p : p + 256]
                    others = right[p:] if whole else right
                    gap = square[rows][:, None] + square[others][None, :] - 2 * (near[rows] @ near[others].T)
                    x, y = np.nonzero(gap <= most[block] + 1e-5)
                    if whole:
                        x, y = x[x < y], y[x < y]
                    x, y = rows[x], others[y]
                    ok = _verified(x, y, unit, unit, z, z, block, bounds, most, threshold)
                    x, y = x[ok], y[ok]
                    np.add.at(links, x, weight[y])
                    np.add.at(links, y, weight[x])
                    for r in np.unique(x):
                        _forest(labels, int(r), y[x == r])
                hit = np.flatnonzero(links)
                if len(hit):
                    root = np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(root, labels, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(root[labels[hit]])], names=["id", "n", "root"])

    return tidy(run)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """Links of vectors with cosine (in double precision) of at least ``threshold``.

    Returns ``id``, ``n_links`` (other vectors linked directly), ``component`` (smallest id reachable)
    and ``kept``; one row per input row. Null and zero vectors and those with null or non-finite
    components link with nothing; vectors of different lengths never link. Equal vectors are one
    class and are joined once. Rows of one id with different vectors are one vertex, and rows that
    repeat are one vector: none is its own neighbour and others count it once. A row without an id
    links with nothing, has no component and is kept. Empty input, empty result; no other column is
    read.

    Slabs are counted first. A slab beyond ``tile`` vectors is compared in tiles, two at a time, so
    a task holds at most two tiles however the vectors cluster. Where vectors fill space evenly and
    the reach of a block is near their spread, slabs prune little and the work is quadratic.
    """
    spark = vectors.sparkSession
    ready(spark)
    dtype = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    element = "array<float>" if dtype == "<f4" else "array<double>"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(element).alias("v"))
    packed = cut(source.mapInArrow(_packed(dtype), "id long, vector binary"))
    named = packed.where("vector is not null and id is not null")
    classes = cut(named.distinct().groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    slabs = cut(classes.select(F.col("rep").alias("id"), "vector").mapInArrow(_slabs(dtype, threshold), "id long, dims int, block int, slab int"))
    # At most 2 / reach + 2 slabs a block.
    tiles = slabs.groupBy("dims", "block", "slab").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("t"))
    key = ["dims", "block", "slab"]
    own = slabs.join(F.broadcast(tiles), key).withColumn("k", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    inside = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select(
        "id", *key, F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"),
        F.when(F.col("k") == F.col("o"), 2).when(F.col("k") < F.col("o"), 0).otherwise(1).alias("side"),
    )
    ahead = tiles.select("dims", "block", (F.col("slab") - 1).alias("slab"), F.col("t").alias("u"))
    behind = tiles.select("dims", "block", (F.col("slab") + 1).alias("slab"), F.col("t").alias("u"))
    # Slab s meets slab s + 1 under the key s; tile numbers of the upper one are negative.
    lower = own.join(F.broadcast(ahead), key).withColumn("o", F.explode(F.sequence(F.lit(1), F.col("u")))).select(
        "id", *key, F.col("k").alias("i"), (-F.col("o")).alias("j"), F.lit(0).alias("side")
    )
    upper = own.join(F.broadcast(behind), key).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("u") - 1))).select(
        "id", "dims", "block", (F.col("slab") - 1).alias("slab"), F.col("o").alias("i"), (-F.col("k") - 1).alias("j"), F.lit(1).alias("side")
    )
    keys = [*key, "i", "j"]
    found = cut(
        inside.unionByName(lower).unionByName(upper)
        .join(classes.select(F.col("rep").alias("id"), "vector", "n"), "id")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_joined(dtype, threshold), "id long, n long, root long")
    )
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("more"))
    reps = classes.select("vector", "rep", "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    linked_rows = named.join(reps, "vector").select("id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # Rows that can link with nothing pass by the join, where they would all share the key null.
    alone = packed.where("vector is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of ``embeddings`` at a cosine of 0.95."""
    found = near_vectors(table(spark, sf_dir, "embeddings"), 0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

QUERIES = {"op10_embedding_dedup": op10}
SQL = {"op10_embedding_dedup": OP10_SQL}
