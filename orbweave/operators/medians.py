"""Exact order statistics of whole columns, by group, without a task that holds a column or a group.

A sketch gives two values that surely have the wanted rank between them; one aggregation counts what
lies below, another counts the distinct values between. Only those are sorted, a few ten-thousandths
of the rows, and ties are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the sketch are right to one part in so many; brackets reach three parts to each side, and
#: are everything where a group has no more values than parts.
ACCURACY = 10_000
_REACH = 3 / ACCURACY


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which nulls are equal; of ``right`` a row a group, of no group one row."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]).drop(*[f"_of_{c}" for c in on])


def quantiles(rows: DataFrame, columns: dict[str, Column], shares: list[float], by: list[str] = ()) -> DataFrame:
    """``by``, ``name``, ``share``, ``value`` and ``n``: the exact quantiles of the non-null values, interpolated between neighbours.

    A column without values has no row. NaN counts as null; infinite values are ordered like others,
    and between two equal ones nothing is interpolated. ``rows`` is read three times, so callers cut
    it first where it is costly.
    """
    by, names = list(by), list(columns)
    own = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in columns.items()}
    values = rows.select(*by, *[c.alias(f"_{i}") for i, c in enumerate(own.values())])
    ends = [min(max(s + side, 0.0), 1.0) for s in shares for side in (-_REACH, _REACH)]
    sketch = values.groupBy(*by).agg(*[x for i in range(len(names)) for x in (F.count(f"_{i}").alias(f"_n{i}"), F.percentile_approx(f"_{i}", ends, ACCURACY).alias(f"_e{i}"), F.min(f"_{i}").alias(f"_lo{i}"), F.max(f"_{i}").alias(f"_hi{i}"))])
    asked = [(i, q) for i in range(len(names)) for q in range(len(shares))]
    few = lambda i, end, v: F.when(F.col(f"_n{i}") <= ACCURACY, F.col(f"_{end}{i}")).otherwise(v)
    low, high = (lambda i, q: few(i, "lo", F.col(f"_e{i}")[2 * q])), (lambda i, q: few(i, "hi", F.col(f"_e{i}")[2 * q + 1]))
    met = _met(values, sketch, by)
    below = met.groupBy(*by).agg(*[F.count_if(F.col(f"_{i}") < low(i, q)).alias(f"_b{i}_{q}") for i, q in asked])
    inside = F.filter(F.array(*[F.when(F.col(f"_{i}").between(low(i, q), high(i, q)), F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col(f"_{i}").alias("v"))) for i, q in asked]), lambda x: x.isNotNull())
    counts = met.select(*by, F.explode(inside).alias("x")).groupBy(*by, "x.i", "x.q", "x.v").agg(F.count(F.lit(1)).alias("c"))
    facts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.lit(names[i]).alias("name"), F.lit(float(shares[q])).alias("share"), F.col(f"_n{i}").alias("n"), F.col(f"_b{i}_{q}").alias("below")) for i, q in asked])).alias("f")
    ranks = _met(sketch, below, by).select(*by, facts).select(*by, "f.*")
    keys = [*by, "i", "q"]
    found = _met(counts, ranks, keys)
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    at = F.col("share") * (F.col("n") - 1)
    has = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("c") <= k)
    both = found.withColumn("upto", upto).groupBy(*by, "name", "share", "n").agg(F.max(F.when(has(F.floor(at)), F.col("v"))).alias("a"), F.max(F.when(has(F.ceil(at)), F.col("v"))).alias("b"))
    part = at - F.floor(at)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).when(part == 0.5, (F.col("a") + F.col("b")) / 2).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return both.select(*by, "name", "share", value.alias("value"), "n")


def medians(rows: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float | None, int]]:
    """Median and number of the non-null values of every column of the whole table; (None, 0) without any."""
    found = {r["name"]: (r["value"], r["n"]) for r in quantiles(rows, columns, [0.5]).collect()}
    return {n: found.get(n, (None, 0)) for n in columns}
