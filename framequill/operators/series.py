"""Ordered-sequence analytics: differences, rolling medians, segments and seams, one window per key.

All take the key columns and the ordering columns. Operators that need one partitioning share it: Spark plans a
single exchange on the key for a chain of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def whole(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors, in double."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def lag_difference(df: DataFrame, key, order, vector: str, name: str = "score") -> DataFrame:
    """Difference with the row before, 0.0 for the first."""
    before = F.lag(vector).over(ordered(key, order))
    return df.withColumn(name, F.coalesce(mean_abs_diff(F.col(vector), before), F.lit(0.0)))


def ring_difference(df: DataFrame, key, order, vector: str, name: str = "diff") -> DataFrame:
    """Difference with the row after; the last row's is with the first. ``is_boundary`` marks the last."""
    after = F.lead(vector).over(ordered(key, order))
    first = F.first_value(vector).over(whole(key, order))
    return (df.withColumn("is_boundary", F.lead(F.lit(1)).over(ordered(key, order)).isNull())
            .withColumn(name, mean_abs_diff(F.col(vector), F.coalesce(after, first))))


def seam_report(df: DataFrame, key, order, vector: str, factor: float = 3.0, floor: float = 5.0) -> DataFrame:
    """Each row's ring difference, the median without the boundary's (0 for a lone row), and whether it is suspect."""
    diffs = ring_difference(df, key, order, vector)
    median = F.percentile(F.when(~F.col("is_boundary"), F.col("diff")), F.lit(0.5)).over(Window.partitionBy(*key))
    return (diffs.withColumn("median_diff", F.coalesce(median, F.lit(0.0)))
            .withColumn("suspect", F.col("diff") > F.greatest(F.col("median_diff") * F.lit(factor), F.lit(floor))))


def rolling_median(df: DataFrame, key, order, value: str, radius: int, name: str = "smooth") -> DataFrame:
    """Centred median over ``radius`` rows each way, cut off at the ends."""
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(ordered(key, order).rowsBetween(-radius, radius)))


def median_radius(fps: float) -> int:
    return max(1, round(fps * 0.08))


def segments(df: DataFrame, key, order, value: str, threshold: float, fps: float, max_gap_s: float, min_duration_s: float) -> DataFrame:
    """Runs of rows with value >= threshold, bridging short gaps; (key, start_i, end_i, start_t, end_t, n, max_score)."""
    max_gap = max(0, math.ceil(max_gap_s * fps))
    by_key = ordered(key, order)
    active = df.withColumn("i", F.row_number().over(by_key) - 1).where(F.col(value) >= threshold)
    along = ordered(key, ["i"])
    opens = F.coalesce((F.col("i") - F.lag("i").over(along) - 1 > max_gap).cast("int"), F.lit(1))
    runs = active.withColumn("opens", opens).withColumn("seg", F.sum("opens").over(along))
    found = runs.groupBy(*key, "seg").agg(F.min("i").alias("start_i"), F.max("i").alias("end_i"), F.max(value).alias("max_score"))
    return (found.withColumn("n", F.col("end_i") - F.col("start_i") + 1)
            .where(F.col("n") / F.lit(fps) >= min_duration_s)
            .withColumn("start_t", F.col("start_i") / F.lit(fps)).withColumn("end_t", (F.col("end_i") + 1) / F.lit(fps)).drop("seg"))


def rate_check(df: DataFrame, key, order, seconds: Column, fps: float) -> DataFrame:
    """(key, n, constant): whether every step is 1/fps within max(2e-5, 0.005/fps); needs three finite times."""
    tolerance = max(2e-5, 0.005 / fps)
    timed = df.withColumn("s", seconds).withColumn("step", F.col("s") - F.lag("s").over(ordered(key, order)))
    finite = F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < float("inf"))
    good = F.coalesce(F.abs(F.col("step") - F.lit(1 / fps)) <= F.lit(tolerance), F.lit(True)) & finite
    return timed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.bool_and(good) & (F.count(F.lit(1)) >= 3)).alias("constant"))


def step_change(df: DataFrame, key, order, value: str, name: str = "change") -> DataFrame:
    """Absolute change from the row before, null for the first."""
    return df.withColumn(name, F.abs(F.col(value) - F.lag(value).over(ordered(key, order))))


def changes_only(df: DataFrame, key, order, value: str) -> DataFrame:
    """Rows whose value differs from the row before; null counts as a value."""
    by_key = ordered(key, order)
    marked = df.withColumn("__same", F.col(value).eqNullSafe(F.lag(value).over(by_key)) & (F.row_number().over(by_key) > 1))
    return marked.where(~F.col("__same")).drop("__same")


def strictly_increasing(df: DataFrame, key, order, value: str) -> DataFrame:
    """(key, n, first, increasing) of each sequence."""
    by_key = ordered(key, order)
    up = df.withColumn("__up", F.coalesce(F.col(value) > F.lag(value).over(by_key), F.lit(True))).withColumn("__nth", F.row_number().over(by_key))
    return up.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__nth") == 1, F.col(value))).alias("first"), F.bool_and("__up").alias("increasing"))


def robust(df: DataFrame, key, value: str) -> DataFrame:
    """Exact median and 95th percentile with linear interpolation, extrema, population spread and the integer-cut median."""
    v = F.col(value)
    return df.groupBy(*key).agg(
        F.count(v).alias("n"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("spread"),
        F.percentile(v, F.lit(0.5)).cast("int").alias("median_cut"))
