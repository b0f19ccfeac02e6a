"""Per-site digests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import domain
from orbweave.operators.events import CLEAR


def series(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Counts per class of every scene, zero where a scene shows none of a class its site has."""
    classes = obs.select("site", "cls").distinct()
    counts = obs.groupBy("scene_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    return scenes.select("scene_id", "site", "time", "source", "clear").join(classes, "site").join(counts, ["scene_id", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_counts(obs: DataFrame, scenes: DataFrame, since: Column) -> DataFrame:
    """Median count per site and class before and after a date, and the latest, over clear looks.

    A clear share of exactly 0 counts as unknown here, as in the reports this reproduces.
    """
    rows = series(obs, scenes).where(F.coalesce(F.when(F.col("clear") != 0, F.col("clear")), F.lit(1.0)) >= CLEAR)
    early = F.to_date("time") < since
    return rows.groupBy("site", "cls").agg(
        F.median(F.when(early, F.col("n"))).alias("baseline_median"),
        F.median(F.when(~early, F.col("n"))).alias("period_median"),
        F.max_by("n", F.struct("time", "scene_id")).alias("latest"),
    )


def notable(summary: DataFrame, n: int = 6) -> DataFrame:
    """The longest, then most often seen tracks of each site."""
    w = Window.partitionBy("site").orderBy(F.coalesce("length_m", F.lit(0.0)).desc(), F.col("n_obs").desc(), "track_id")
    return summary.where(F.col("cls").isin("vessel", "aircraft")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def length_histogram(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.groupBy(*by, domain.length_bin(F.col("length_m")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def markdown(counts: DataFrame) -> DataFrame:
    """One Markdown line per site: its classes with their medians."""
    text = lambda c: F.coalesce(F.format_string("%.1f", F.col(c)), F.lit("-"))
    line = F.concat(F.lit("**"), F.col("cls"), F.lit("** "), text("baseline_median"), F.lit(" -> "), text("period_median"))
    return counts.groupBy("site").agg(F.array_sort(F.collect_list(line)).alias("lines")).select("site", F.concat(F.lit("## "), F.col("site"), F.lit("\n"), F.array_join("lines", "; ")).alias("brief"))
