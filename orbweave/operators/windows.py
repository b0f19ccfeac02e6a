"""Sequence operators as window functions and folds."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.sources.paths import cut

#: Scales a median absolute deviation to a standard deviation.
MAD = 1.4826


def fold(rows: DataFrame, by: list[str], order: list[Column | str], step: Callable, columns: dict[str, str]) -> DataFrame:
    """``rows`` with more columns that a fold over each series in order gives.

    ``step()`` makes a series' state: a function from a row (a dict) to the new columns' values. Rows
    stream through a task sorted by series and order, so memory is the state of one series.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                own = tuple(r[c] for c in by)
                if own != key:
                    key, state = own, step()
                made.append(state(r))
            more = [pa.array([m[i] for m in made], type=from_ddl(columns[n])) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` {t}" for n, t in columns.items()])
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def from_ddl(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def _nth_gap(values: list[float], middle: float, k: int) -> float:
    """k-th smallest distance of sorted values to ``middle``, by bisection over how many lie on either side."""
    right = bisect.bisect_left(values, middle)
    low, high = max(0, k + 1 - (len(values) - right)), min(right, k + 1)
    while low < high:  # how many of the k + 1 nearest lie on the left
        take = (low + high) // 2
        if right - take - 1 >= 0 and middle - values[right - take - 1] < values[right + k - take] - middle:
            low = take + 1
        else:
            high = take
    left = middle - values[right - low] if low else -math.inf
    rest = values[right + k - low] - middle if k + 1 - low else -math.inf
    return max(left, rest)


def _mean_of_middle(nth: Callable[[int], float], n: int) -> float:
    return (nth((n - 1) // 2) + nth(n // 2)) / 2.0


def prefix_robust_z(series: DataFrame, by: list[str], order: list[str], value: str, least: int = 4) -> DataFrame:
    """Robust z-score of each value against all values before it in its series.

    z = (value - median) / (MAD + sqrt(max(median, 1))); rows with fewer than ``least`` values before
    go. One pass over the sorted series, whose values so far are kept sorted.
    """

    def start():
        held: list[float] = []

        def step(r: dict) -> tuple[float | None, float | None]:
            v, out = float(r[value]), (None, None)
            if len(held) >= least:
                med = _mean_of_middle(held.__getitem__, len(held))
                mad = _mean_of_middle(lambda k: _nth_gap(held, med, k), len(held)) * MAD
                out = (med, (v - med) / (mad + math.sqrt(max(med, 1.0))))
            bisect.insort(held, v)
            return out

        return step

    return fold(series, by, order, start, {"median": "double", "z": "double"}).where(F.col("median").isNotNull())


def first_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the given order, which must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def with_group_start(rows: DataFrame, by: list[str], time: str, limit_s: float, order: list[str] | None = None) -> DataFrame:
    """``rows`` with ``group_start``: the time (seconds) of the first row of their group.

    A group takes rows up to ``limit_s`` after its first one; unlike session windows, a gap is measured
    from the group's start.
    """

    def start():
        first = [-math.inf]

        def step(r: dict) -> tuple[float]:
            t = float(r[time])
            if t - first[0] > limit_s:
                first[0] = t
            return (first[0],)

        return step

    return fold(rows, by, [time, *(order or [])], start, {"group_start": "double"})


def anchored_groups(rows: DataFrame, by: list[str], time: str, limit_s: float) -> DataFrame:
    """``by``, ``group_start`` and the number of rows ``n`` of every anchored group."""
    return with_group_start(rows.select(*by, F.col(time).cast("double").alias(time)), by, time, limit_s).groupBy(*by, "group_start").agg(F.count(F.lit(1)).alias("n"))


def local_minima(rows: DataFrame, by: list[str], order: str, value: str, below: float, bucket: float | None = None) -> DataFrame:
    """Rows lower than the one before, not higher than the one after, and under ``below``.

    With ``bucket``, a width of ``order``, only rows of buckets that hold one under ``below`` are shuffled and sorted; every other
    bucket is one row, which like all of its rows is higher than what it is compared with. ``rows`` is then read twice.
    """
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    if bucket is not None:
        keyed = rows.where(F.col(order).isNotNull()).withColumn("_k", F.floor(F.col(order) / F.lit(float(bucket))))
        held = cut(keyed.groupBy(*by, "_k").agg(F.min(order).alias(order), F.count_if(v < below).alias("_c"), F.count(F.lit(1)).alias("_all"), F.count_if(v >= below).alias("_over")))
        # A bucket of which a value is unknown stays whole, as nothing is higher or lower than null.
        near = (F.col("_c") > 0) | (F.col("_over") < F.col("_all"))
        # Sixty-four buckets are a bit each of one number, so the marks are small enough to go to every task.
        at = F.pmod(F.col("_k"), F.lit(64)).cast("int")
        marks = held.where(near).groupBy(*[F.col(c).alias(f"_h_{c}") for c in by], F.floor(F.col("_k") / 64).alias("_h_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("_m"))
        met = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by] + [F.floor(F.col("_k") / 64) == F.col("_h_w")]
        kept = keyed.join(F.broadcast(marks), met).where(F.bit_get(F.col("_m"), at) == 1).select(*rows.columns)
        kinds = dict(rows.dtypes)
        far = held.where(~near).select(*[F.col(c) if c in (*by, order) else F.lit(float("inf")).cast(kinds[c]).alias(c) if c == value else F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns])
        rows = kept.unionByName(far)
    return rows.withColumn("_p", F.lag(v).over(w)).withColumn("_n", F.lead(v).over(w)).where((v < F.col("_p")) & (v <= F.col("_n")) & (v < below)).drop("_p", "_n")


def with_rest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with the group's size in ``group_size``."""
    w = Window.partitionBy(*by)
    return rows.withColumn("group_size", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= n)
