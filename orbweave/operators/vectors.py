"""Searching and comparing embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.medians import medians
from orbweave.operators.windows import MAD
from orbweave.sources.paths import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; unchanged if it has none. The norm is bound once, not per element."""
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def prototype(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Unit vector of the mean of unit vectors, one row."""
    u = rows.select(unit(F.col(vector)).alias("u"))
    mean = u.agg(*[F.avg(F.get("u", F.lit(i))).alias(f"m{i}") for i in range(dims)])
    return mean.select(unit(F.array(*[F.col(f"m{i}") for i in range(dims)])).alias("prototype"))


def similar(rows: DataFrame, vector: str, example: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows by cosine to the one-row ``example``'s ``prototype``."""
    scored = rows.crossJoin(F.broadcast(example)).withColumn("score", cosine(F.col(vector), F.col("prototype"))).drop("prototype")
    return scored.orderBy(F.col("score").desc(), *[c for c in ("vec_id", "id") if c in rows.columns]).limit(top)


def moments(rows: DataFrame, vector: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance. Partitions sum their own products, the sums meet by position, dims^2 numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + dims + dims * dims)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, dims)
            sums += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "v"])

    parts = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "place long, v double")
    sums = np.array([r["v"] for r in parts.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()])
    if not len(sums) or not sums[0]:
        raise ValueError("no vectors")
    n, mean = sums[0], sums[1 : dims + 1] / sums[0]
    return mean, sums[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)


def whitener(rows: DataFrame, vector: str, dims: int, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Mean and whitening matrix of all vectors."""
    mean, spread = moments(rows, vector, dims)
    value, axis = np.linalg.eigh(spread)
    sd = np.sqrt(np.maximum(value, 0))
    return mean, axis / (sd + sd.max() * ridge)


def whitened(rows: DataFrame, key: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``key`` and the whitened vector of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(mean)) - mean) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), type=pa.list_(pa.float64()))], names=[key, vector])

    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {vector} array<double>")


def changed(before: DataFrame, after: DataFrame, key: str, vector: str, k: float = 3.0, least: float = 0.15) -> DataFrame:
    """Cosine distance of a cell's two vectors, its robust z over all cells, and whether it changed.

    Norms are taken on each side before the join, the distances are cut once, and their medians counted.
    """
    side = lambda rows, v, n: rows.select(key, F.col(vector).alias(v), norm(F.col(vector)).alias(n))
    rows = side(before, "a", "na").join(side(after, "b", "nb"), key)
    length = F.when(F.col("na") > 0, F.col("na")).otherwise(1.0) * F.when(F.col("nb") > 0, F.col("nb")).otherwise(1.0)
    rows = cut(rows.select(key, (F.lit(1.0) - dot(F.col("a"), F.col("b")) / length).alias("distance")))
    med, _ = medians(rows, {"d": F.col("distance")})["d"]
    mad, _ = medians(rows, {"d": F.abs(F.col("distance") - F.lit(med))})["d"] if med is not None else (None, 0)
    spread = max((mad or 0.0) * MAD, 0.01)
    z = (F.col("distance") - F.lit(med or 0.0)) / F.lit(spread)
    return rows.withColumn("z", z).withColumn("changed", (F.col("z") > k) & (F.col("distance") > least))


def probe(positive: np.ndarray, negative: np.ndarray, l2: float = 1e-2, steps: int = 300, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a balanced logistic regression, by gradient descent from zero."""
    x = np.vstack([positive, negative]).astype(np.float64)
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    share = np.where(y == 1, len(negative) / max(len(positive), 1), 1.0)
    share = share / share.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - rate * (x.T @ error + l2 * w), b - rate * float(error.sum())
    return w, b


def probed(rows: DataFrame, vector: str, w: np.ndarray, b: float) -> DataFrame:
    weights = F.array(*[F.lit(float(v)) for v in w])
    return rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot(F.col(vector), weights) + F.lit(float(b))))))


def k_means(rows: DataFrame, key: str, vector: str, k: int, dims: int, rounds: int = 25) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's iterations from the k rows of smallest key hash; an empty cluster keeps its centre."""
    from pyspark.sql import types as T

    first = rows.orderBy(F.xxhash64(key), key).limit(k).select(vector).collect()
    centres = np.array([r[0] for r in first], dtype=np.float64)
    cached = rows.select(key, F.col(vector).cast(T.ArrayType(T.DoubleType())).alias("v")).persist()
    assigned = cached
    for _ in range(rounds):
        gaps = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x) for c in centres]
        assigned = cached.withColumn("cluster", F.array_position(F.array(*gaps), F.least(*gaps)) - 1 if k > 1 else F.lit(0).cast("long"))
        found = assigned.groupBy("cluster").agg(*[F.avg(F.get("v", F.lit(i))) for i in range(dims)]).collect()
        moved = centres.copy()
        for r in found:
            moved[r["cluster"]] = [r[i + 1] for i in range(dims)]
        if np.array_equal(moved, centres):
            break
        centres = moved
    return assigned.select(key, "cluster"), centres
